"""XML Schema to a graph of types, and from there to Spark schemas and tables.

The graph is small and lives on the driver: a registry from keys (namespace/name) to nodes. A node is a dict with a ``kind``:

* ``leaf``: base (name of a builtin), facets {enum, min, max, pattern}
* ``list``: item; ``union``: members
* ``map``: fields, unordered by name; ``cat``: ordered parts; ``choice``: one of its arms
* ``wrapped``: attribute fields and a value node; ``any``: open content; ``empty``
* ``ref``: key, resolved late, so types may be cyclic

A field or part has name, node, min, max (None: unbounded), and for attributes attr = True; docs where the schema has them.
"""

from __future__ import annotations

import json
import os
import re
from decimal import Decimal
from urllib.parse import urljoin
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.leaf import LEAVES, leaf

XS = "{http://www.w3.org/2001/XMLSchema}"
XS_NS = "org.w3.www.2001.XMLSchema"
#: Builtin lists and open content.
BUILTIN_LISTS = {"IDREFS": "IDREF", "NMTOKENS": "NMTOKEN", "ENTITIES": "ENTITY"}
OPEN = {"anyType"}
#: Patterns of the schema language's own name types, and what stands for them.
NAME_PATTERNS = {r"\i\c*": r"[\p{L}_:][\p{L}\p{N}._:·-]*", r"[\i-[:]][\c-[:]]*": r"[\p{L}_][\p{L}\p{N}._·-]*", r"\c+": r"[\p{L}\p{N}._:·-]+"}


NUMERIC = ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive", "totalDigits", "fractionDigits")


def _bound(text: str) -> Decimal:
    return Decimal(text)


class SchemaError(ValueError):
    """reason: a short word for the kind of error."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def namespace_key(uri: str | None) -> str:
    """http://host.of/a to of.host.a; urn:a:b to b.a."""
    if not uri:
        return ""
    if uri.startswith("urn:"):
        return ".".join(p for p in reversed(uri[4:].split(":")) if p)
    m = re.match(r"[A-Za-z][\w+.-]*://([^/?#:]*)[^/?#]*([^?#]*)", uri)
    return ".".join(p for p in [*reversed(m[1].split(".")), *m[2].split("/")] if p) if m else uri


def _doc(e: ET.Element) -> str | None:
    got = [("".join(d.itertext())).strip() for a in e.findall(f"{XS}annotation") for d in a.findall(f"{XS}documentation")]
    return "\n".join(t for t in got if t) or None


def _occurs(e: ET.Element) -> tuple[int, int | None]:
    hi = e.get("maxOccurs", "1")
    return int(e.get("minOccurs", "1")), None if hi == "unbounded" else int(hi)


class SchemaGraph:
    def __init__(self, types: dict[str, dict], elements: dict[str, dict], root: str | None = None, closed: bool = False, bases: dict[str, str] | None = None):
        self.types, self.elements, self.root, self.closed = types, elements, root, closed
        #: of each type that extends another, that one
        self.bases = bases or {}

    def extensions(self, key: str) -> list[str]:
        """Types that extend ``key``, directly or not, in order."""
        out = [k for k, b in sorted(self.bases.items()) if b == key and k in self.types and k != key]
        return out + [x for k in out for x in self.extensions(k) if x not in out]

    def with_root(self, name: str, closed: bool | None = None) -> SchemaGraph:
        if name not in self.types and name not in self.elements:
            raise SchemaError("missing-key", name)
        return SchemaGraph(self.types, self.elements, name, self.closed if closed is None else closed, self.bases)

    def node(self, key: str) -> dict:
        if key in self.types:
            return self.types[key]
        if key in self.elements:
            return self.elements[key]["node"]
        raise SchemaError("missing-key", key)

    def resolve(self, node: dict) -> dict:
        seen = set()
        while node["kind"] == "ref":
            if node["key"] in seen:
                raise SchemaError("endless-ref", node["key"])
            seen.add(node["key"])
            node = self.node(node["key"])
        return node

    # references

    @staticmethod
    def refs(node: dict) -> set[str]:
        out: set[str] = set()

        def walk(x):
            if isinstance(x, dict):
                if x.get("kind") == "ref":
                    out.add(x["key"])
                for v in x.values():
                    walk(v)
            elif isinstance(x, list):
                for v in x:
                    walk(v)

        walk(node)
        return out

    def reachable(self, roots: list[str]) -> set[str]:
        """Keys that the roots reach, themselves included; unknown roots are an error."""
        seen: set[str] = set()
        todo = list(roots)
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += [r for r in self.refs(self.node(k)) if r not in seen]
        return seen

    def trim(self, roots: list[str]) -> SchemaGraph:
        keep = self.reachable(roots)
        return SchemaGraph({k: v for k, v in sorted(self.types.items()) if k in keep}, {k: v for k, v in sorted(self.elements.items()) if k in keep}, self.root if self.root in keep else None, self.closed, {k: b for k, b in sorted(self.bases.items()) if k in keep})

    def is_cyclic(self, key: str) -> bool:
        return any(key in self.reachable([r]) for r in self.refs(self.node(key)))

    # Spark types

    def to_struct(self, key: str | None = None, depth: int = 4, typed_attributes: bool = False) -> T.DataType:
        """The Spark type of an element or type; recursion is unrolled ``depth`` times and then cut."""
        return self._type(self.node(key or self.root), (), depth, typed_attributes)

    def _type(self, node: dict, path: tuple, depth: int, typed: bool) -> T.DataType | None:
        kind = node["kind"]
        if kind == "ref":
            if path.count(node["key"]) >= depth:
                return None
            return self._type(self.node(node["key"]), (*path, node["key"]), depth, typed)
        if kind == "leaf":
            return leaf(node["base"]).data_type
        if kind == "list":
            return T.ArrayType(self._type(node["item"], path, depth, typed) or T.StringType())
        if kind in ("union", "any"):
            return T.StringType()
        if kind == "empty":
            return T.BooleanType()
        if kind == "map":
            return self._struct(node["fields"], path, depth, typed)
        if kind == "wrapped":
            attrs = self._struct(node["attrs"], path, depth, typed)
            value = self._type(node["value"], path, depth, typed)
            if value is None:
                return attrs
            if isinstance(value, T.StructType) and self.resolve(node["value"])["kind"] in ("map",):
                return T.StructType([*attrs.fields, *[f for f in value.fields if f.name not in attrs.names]])
            return T.StructType([*attrs.fields, T.StructField("_VALUE", value)])
        if kind == "choice":
            arms = self._struct(node["arms"], path, depth, typed, True)
            return T.StructType([T.StructField("tag", T.StringType()), *arms.fields])
        if kind == "cat":  # order matters: items as they come
            return T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("value", T.StringType())]))
        raise SchemaError("unknown-kind", kind)

    def _struct(self, fields: list[dict], path: tuple, depth: int, typed: bool, optional: bool = False) -> T.StructType:
        out: dict[str, T.StructField] = {}
        for f in fields:
            kind = T.StringType() if f.get("attr") and not typed else self._type(f["node"], path, depth, typed)
            if kind is None:
                continue
            if f.get("max", 1) != 1 and not f.get("attr"):
                kind = T.ArrayType(kind)
            name = ("_" if f.get("attr") else "") + f["name"]
            meta = {k: f[k] for k in ("doc", "min", "max", "group") if f.get(k) is not None}
            if name not in out:
                out[name] = T.StructField(name, kind, True, meta)
            elif not isinstance(out[name].dataType, T.ArrayType):
                out[name] = T.StructField(name, T.ArrayType(out[name].dataType), True, meta)
        return T.StructType(list(out.values()))

    # tables

    def to_dataframes(self, spark: SparkSession) -> dict[str, DataFrame]:
        """xsd_types(key, kind, form), xsd_fields(key, name, min, max, attr, base), xsd_facets(key, facet, value), xsd_refs(source, target)."""
        types, fields, facets, refs = [], [], [], []
        for key, node in self.entries():
            types.append((key, node["kind"], json.dumps(node, sort_keys=True)))
            refs += [(key, r) for r in sorted(self.refs(node))]
            for f in self.fields(node):
                fields.append((key, f["name"], f.get("min", 1), f.get("max", 1), bool(f.get("attr")), f["node"].get("base")))
            facets += [(key, k, str(v)) for k, vs in sorted(node.get("facets", {}).items()) for v in (vs if isinstance(vs, list) else [vs])]
        return {
            "xsd_types": spark.createDataFrame(types, "key string, kind string, form string"),
            "xsd_fields": spark.createDataFrame(fields, "key string, name string, min int, max int, attr boolean, base string"),
            "xsd_facets": spark.createDataFrame(facets, "key string, facet string, value string"),
            "xsd_refs": spark.createDataFrame(refs, "source string, target string"),
        }

    def entries(self) -> list[tuple[str, dict]]:
        return sorted([*self.types.items(), *((k, v["node"]) for k, v in self.elements.items() if k not in self.types)])

    def fields(self, node: dict) -> list[dict]:
        """Attributes and children of a node, those of its value included."""
        kind = node["kind"]
        if kind == "map":
            return node["fields"]
        if kind == "wrapped":
            return node["attrs"] + self.fields(node["value"])
        return [f for f in node.get("parts", node.get("arms", [])) if "name" in f]

    def to_json(self) -> str:
        return json.dumps({"types": {k: canonical(v) for k, v in sorted(self.types.items())}, "elements": {k: {**v, "node": canonical(v["node"])} for k, v in sorted(self.elements.items())}, "root": self.root, **({"bases": self.bases} if self.bases else {})}, sort_keys=True, indent=1)

    @classmethod
    def from_json(cls, text: str) -> SchemaGraph:
        got = json.loads(text)
        return cls(got["types"], got["elements"], got["root"], bases=got.get("bases"))

    def emit(self, folder: str, roots: list[str] | None = None) -> list[str]:
        """One JSON file for each type, and a manifest; the same bytes for the same graph."""
        graph = self.trim(roots) if roots else self
        paths: dict[str, str] = {}
        for key, node in graph.entries():
            ns, _, name = key.rpartition("/")
            if not ns:
                raise SchemaError("no-namespace", key)
            path = f"{ns}.{name.replace('.', '_')}".replace("-", "_").replace(".", "/") + ".json"
            if path.lower() in {p.lower() for p in paths}:
                raise SchemaError("path-collision", path)
            paths[path] = json.dumps({"key": key, "refs": sorted(self.refs(node)), "form": canonical(node)}, sort_keys=True, indent=1)
        for path, text in sorted(paths.items()):
            os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
            with open(f"{folder}/{path}", "w") as f:
                f.write(text + "\n")
        with open(f"{folder}/manifest.json", "w") as f:
            json.dump({"files": sorted(paths), "roots": sorted(graph.elements)}, f, indent=1)
        return sorted(paths)


def canonical(node):
    """Attributes by name among their own places, and no empty properties."""
    if isinstance(node, dict):
        out = {k: canonical(v) for k, v in node.items() if v not in ({}, None)}
        for part in ("fields", "attrs"):
            if part in out:
                rows = out[part]
                by_name = iter(sorted((r for r in rows if r.get("attr")), key=lambda r: r["name"]))
                out[part] = [next(by_name) if r.get("attr") else r for r in rows]
        return out
    return [canonical(x) for x in node] if isinstance(node, list) else node


class _Compiler:
    def __init__(self, default: str):
        self.default = default
        self.target = ""
        self.raw: dict[tuple[str, str], tuple[ET.Element, str, dict, bool]] = {}
        self.types: dict[str, dict] = {}
        self.elements: dict[str, dict] = {}
        self.loaded: set[str] = set()
        self.bases: dict[str, str] = {}

    def load(self, path: str, namespace: str | None = None) -> None:
        path = os.path.abspath(path)
        if path in self.loaded:
            return
        self.loaded.add(path)
        prefixes: dict[str, str] = {}
        root = None
        for event, got in ET.iterparse(path, ("start", "start-ns")):
            if event == "start-ns":
                prefixes.setdefault(got[0] or "", got[1])
            elif root is None:
                root = got
        self.add(root, prefixes, namespace, lambda where: self.load(urljoin(path, where)) if os.path.exists(urljoin(path, where)) else None)

    def add(self, root: ET.Element, prefixes: dict, namespace: str | None, follow) -> None:
        if root.tag != XS + "schema":
            raise SchemaError("not-a-schema", root.tag)
        target = root.get("targetNamespace", namespace or "")
        qualified = root.get("elementFormDefault") == "qualified"
        for e in root:
            name = e.tag.removeprefix(XS)
            if name in ("include", "import", "redefine") and e.get("schemaLocation"):
                follow(e.get("schemaLocation"))
            if e.get("name"):
                self.raw[name, self.key(target, e.get("name"))] = (e, target, prefixes, qualified)
            if name == "redefine":
                for x in e:
                    if x.get("name"):
                        self.raw[x.tag.removeprefix(XS), self.key(target, x.get("name"))] = (x, target, prefixes, qualified)

    def key(self, uri: str, name: str) -> str:
        return f"{namespace_key(uri) or self.default}/{name}"

    def name(self, text: str) -> tuple[str, str]:
        prefix, _, local = text.rpartition(":")
        return self.prefixes.get(prefix, "" if prefix else self.target), local

    def compile(self) -> SchemaGraph:
        for (kind, key), (e, target, prefixes, _) in sorted(self.raw.items()):
            self.target, self.prefixes = target, prefixes
            if kind == "complexType":
                self.types[key] = self.complex(e)
                if (x := e.find(f"{XS}complexContent/{XS}extension")) is not None:
                    self.bases[key] = self.key(*self.name(x.get("base")))
            elif kind == "simpleType":
                self.types[key] = self.simple(e)
            elif kind == "group":
                self.types.setdefault(key, self.particle_body(e))
        for (kind, key), (e, target, prefixes, _) in sorted(self.raw.items()):
            self.target, self.prefixes = target, prefixes
            if kind == "element":
                self.elements[key] = {"name": e.get("name"), "ns": target, "node": self.element_node(e), "abstract": e.get("abstract") == "true"} | ({"doc": _doc(e)} if _doc(e) else {})
        return SchemaGraph(self.types, self.elements, next(iter(sorted(self.elements)), None), bases=self.bases)

    # simple types

    def type_ref(self, text: str) -> dict:
        uri, local = self.name(text)
        if uri == "http://www.w3.org/2001/XMLSchema" and ("simpleType", self.key(uri, local)) not in self.raw and ("complexType", self.key(uri, local)) not in self.raw:
            return self.builtin(local)
        return {"kind": "ref", "key": self.key(uri, local)}

    @staticmethod
    def builtin(local: str) -> dict:
        if local in OPEN:
            return {"kind": "any"}
        if local in BUILTIN_LISTS:
            return {"kind": "list", "item": {"kind": "leaf", "base": BUILTIN_LISTS[local]}}
        return {"kind": "leaf", "base": local if local in LEAVES else "string"}

    def simple(self, e: ET.Element) -> dict:
        if (r := e.find(f"{XS}restriction")) is not None:
            inner = r.find(f"{XS}simpleType")
            base = self.simple(inner) if inner is not None else self.type_ref(r.get("base"))
            flat = self.flat(base)
            if flat["kind"] != "leaf":
                return {"kind": "leaf", "base": "string", "facets": self.facets(r, {})} if flat["kind"] == "union" and r.findall(f"{XS}enumeration") else base
            node = {"kind": "leaf", "base": flat["base"]}
            facets = self.facets(r, flat.get("facets", {}))
            if not isinstance(leaf(flat["base"]).data_type, T.StringType):  # of typed values, those on numbers are checked
                facets = {k: v for k, v in facets.items() if k in NUMERIC} if isinstance(leaf(flat["base"]).data_type, T.NumericType) else {}
            if facets:
                node["facets"] = facets
            return node
        if (x := e.find(f"{XS}list")) is not None:
            inner = x.find(f"{XS}simpleType")
            return {"kind": "list", "item": self.simple(inner) if inner is not None else self.type_ref(x.get("itemType"))}
        if (x := e.find(f"{XS}union")) is not None:
            return {"kind": "union", "members": [*map(self.type_ref, (x.get("memberTypes") or "").split()), *map(self.simple, x.findall(f"{XS}simpleType"))]}
        return {"kind": "leaf", "base": "string"}

    def flat(self, node: dict) -> dict:
        """What a reference to a simple type stands for, compiled on the spot."""
        if node["kind"] != "ref":
            return node
        got = self.raw.get(("simpleType", node["key"]))
        if got is None:
            return node
        held = self.target, self.prefixes
        _, self.target, self.prefixes, _ = got
        out = self.flat(self.simple(got[0]))
        self.target, self.prefixes = held
        return out

    @staticmethod
    def facets(r: ET.Element, base: dict) -> dict:
        out = dict(base)
        if values := [x.get("value") for x in r.findall(f"{XS}enumeration")]:
            out["enum"] = [v for v in values if v in base["enum"]] if "enum" in base else values
        for name, keys in (("length", ("min", "max")), ("minLength", ("min",)), ("maxLength", ("max",))):
            for x in r.findall(f"{XS}{name}"):
                for k in keys:
                    v = int(x.get("value"))
                    out[k] = max(v, out.get(k, v)) if k == "min" else min(v, out.get(k, v))
        for name, pick in (("minInclusive", max), ("minExclusive", max), ("maxInclusive", min), ("maxExclusive", min), ("totalDigits", min), ("fractionDigits", min)):
            for x in r.findall(f"{XS}{name}"):
                held = out.get(name)
                out[name] = x.get("value") if held is None else pick(held, x.get("value"), key=_bound)
        # patterns of one step are alternatives, those of different steps all hold
        if here := [NAME_PATTERNS.get(x.get("value"), x.get("value")) for x in r.findall(f"{XS}pattern")]:
            out["pattern"] = [*base.get("pattern", []), "|".join(f"(?:{p})" for p in here) if len(here) > 1 else here[0]]
        return out

    # complex types

    def attributes(self, e: ET.Element) -> list[dict]:
        out = []
        for a in e:
            if a.tag == XS + "attribute":
                if a.get("use") == "prohibited":
                    continue
                if a.get("ref"):
                    uri, local = self.name(a.get("ref"))
                    got = self.raw.get(("attribute", self.key(uri, local)))
                    node = self.attribute_type(got[0]) if got else {"kind": "leaf", "base": "string"}
                    f = {"name": local, "node": node, "attr": True, "ns": uri}
                else:
                    f = {"name": a.get("name"), "node": self.attribute_type(a), "attr": True}
                f |= {"min": int(a.get("use") == "required"), "max": 1}
                if _doc(a):
                    f["doc"] = _doc(a)
                out.append(f)
            elif a.tag == XS + "attributeGroup":
                uri, local = self.name(a.get("ref"))
                got = self.raw.get(("attributeGroup", self.key(uri, local)))
                if got is None:
                    raise SchemaError("missing-key", a.get("ref"))
                held = self.target, self.prefixes
                _, self.target, self.prefixes, _ = got
                out += self.attributes(got[0])
                self.target, self.prefixes = held
        return list({f["name"]: f for f in out}.values())

    def attribute_type(self, a: ET.Element) -> dict:
        inner = a.find(f"{XS}simpleType")
        return self.simple(inner) if inner is not None else self.type_ref(a.get("type")) if a.get("type") else {"kind": "leaf", "base": "string"}

    def base_type(self, text: str) -> tuple[list[dict], dict | None]:
        """Attributes and content of the type that is extended."""
        uri, local = self.name(text)
        key = self.key(uri, local)
        got = self.raw.get(("complexType", key))
        if got is None:
            return [], self.type_ref(text)
        held = self.target, self.prefixes
        _, self.target, self.prefixes, _ = got
        out = self.parts(got[0])
        self.target, self.prefixes = held
        return out

    def parts(self, e: ET.Element) -> tuple[list[dict], dict | None]:
        """Attribute fields and content node (None: empty) of a complex type."""
        if (s := e.find(f"{XS}simpleContent")) is not None:
            d = s.find(f"{XS}extension")
            d = s.find(f"{XS}restriction") if d is None else d
            attrs, content = self.base_type(d.get("base"))
            if d.tag == XS + "restriction" and content is not None:
                inner = d.find(f"{XS}simpleType")
                content = self.simple(inner) if inner is not None else content
            return list({f["name"]: f for f in attrs + self.attributes(d)}.values()), content
        if (c := e.find(f"{XS}complexContent")) is not None:
            d = c.find(f"{XS}extension")
            restricted = d is None
            d = c.find(f"{XS}restriction") if restricted else d
            attrs, before = self.base_type(d.get("base"))
            own = self.content(d, c.get("mixed") == "true" or e.get("mixed") == "true")
            if restricted or before is None or before["kind"] == "any":
                content = own
            elif own is None:
                content = before
            else:
                content = self.joined(before, own)
            return list({f["name"]: f for f in attrs + self.attributes(d)}.values()), content
        return self.attributes(e), self.content(e, e.get("mixed") == "true")

    @staticmethod
    def joined(a: dict, b: dict) -> dict:
        names = lambda n: {f["name"] for f in n["fields"]}
        if a["kind"] == b["kind"] == "map" and not names(a) & names(b):
            return {"kind": "map", "fields": a["fields"] + b["fields"]}
        return {"kind": "cat", "parts": [{"node": a, "min": 1, "max": 1}, {"node": b, "min": 1, "max": 1}]}

    def content(self, e: ET.Element, mixed: bool) -> dict | None:
        for x in e:
            if x.tag in (XS + "sequence", XS + "choice", XS + "all", XS + "group"):
                if mixed:
                    return {"kind": "any", "mixed": True}
                lo, hi = _occurs(x)
                if hi == 0:
                    return None
                node = self.particle(x)
                if (lo, hi) == (1, 1):
                    return node
                if (lo, hi) == (0, 1) and node["kind"] == "choice":
                    return node | {"min": 0}
                if (lo, hi) == (0, 1) and node["kind"] == "map":
                    return {"kind": "map", "fields": [f | {"min": 0, "group": 1} for f in node["fields"]]}
                return {"kind": "cat", "parts": [{"node": node, "min": lo, "max": hi}]}
        return {"kind": "any", "mixed": True} if mixed else None

    def particle_body(self, e: ET.Element) -> dict:
        for x in e:
            if x.tag in (XS + "sequence", XS + "choice", XS + "all"):
                return self.particle(x)
        return {"kind": "empty"}

    def particle(self, e: ET.Element) -> dict:
        if e.tag == XS + "group":
            uri, local = self.name(e.get("ref"))
            return {"kind": "ref", "key": self.key(uri, local)}
        rows = []
        for x in e:
            lo, hi = (1, 1) if x.tag == XS + "annotation" else _occurs(x)
            if hi == 0 or x.tag == XS + "annotation":
                continue
            if x.tag == XS + "element":
                f = {"name": (x.get("name") or self.name(x.get("ref"))[1]), "node": self.element_node(x), "min": lo, "max": hi}
                if _doc(x):
                    f["doc"] = _doc(x)
                rows.append(f)
            elif x.tag == XS + "any":
                rows.append({"node": {"kind": "any"}, "min": lo, "max": hi})
            else:
                rows.append({"node": self.particle(x), "min": lo, "max": hi})
        if e.tag == XS + "choice":
            if all("name" in f for f in rows):
                return {"kind": "choice", "arms": rows}
            return {"kind": "choice", "arms": [f if "name" in f else f | {"name": f"group{k}", "group_arm": True} for k, f in enumerate(rows)]}
        if len(rows) == 1 and rows[0]["node"]["kind"] == "any" and "name" not in rows[0]:
            return {"kind": "any"}
        flat = self.flattened(rows)
        if flat is not None:
            return {"kind": "map", "fields": flat}
        return {"kind": "cat", "parts": rows}

    @staticmethod
    def flattened(rows: list[dict]) -> list[dict] | None:
        """Fields of a sequence with unique names, in which only nested sequences that come at most once stand beside elements."""
        out: list[dict] = []
        for k, f in enumerate(rows):
            if "name" in f:
                out.append(f)
            elif f["node"]["kind"] == "map" and f["max"] == 1:
                out += [g | ({"min": 0, "group": k} if f["min"] == 0 else {}) for g in f["node"]["fields"]]
            elif f["node"]["kind"] == "choice" and f["max"] == 1 and sum(g["node"]["kind"] == "choice" and "name" not in g for g in rows) == 1:
                out.append({"name": "choice", "node": f["node"], "min": f["min"], "max": 1, "inline": True})
            else:
                return None
        names = [f["name"] for f in out]
        return out if len(set(names)) == len(names) else None

    def complex(self, e: ET.Element) -> dict:
        attrs, content = self.parts(e)
        if not attrs:
            return content or {"kind": "empty"}
        if content is None:
            return {"kind": "map", "fields": attrs}
        if content["kind"] == "map":
            return {"kind": "map", "fields": attrs + content["fields"]}
        return {"kind": "wrapped", "attrs": attrs, "value": content}

    def element_node(self, e: ET.Element) -> dict:
        if e.get("ref"):
            uri, local = self.name(e.get("ref"))
            return {"kind": "ref", "key": self.key(uri, local)}
        if e.get("type"):
            return self.type_ref(e.get("type"))
        if (x := e.find(f"{XS}complexType")) is not None:
            return self.complex(x)
        if (x := e.find(f"{XS}simpleType")) is not None:
            return self.simple(x)
        return {"kind": "any"}


def load(path: str, default_namespace: str = "local") -> SchemaGraph:
    """Compile an XSD file, with those that it includes or imports from disk."""
    c = _Compiler(default_namespace)
    c.load(path)
    return c.compile()


def loads(text: str, default_namespace: str = "local") -> SchemaGraph:
    prefixes: dict[str, str] = {}
    root = None
    parser = ET.XMLPullParser(("start", "start-ns"))
    parser.feed(text)
    for event, got in parser.read_events():
        if event == "start-ns":
            prefixes.setdefault(got[0] or "", got[1])
        elif root is None:
            root = got
    c = _Compiler(default_namespace)
    c.add(root, prefixes, None, lambda where: None)
    return c.compile()


def check_sequence_names(names: set[str]) -> None:
    if bad := sorted(n for n in names if f"{n}-seq" in names):
        raise SchemaError("name-collision", ", ".join(bad))


# choices to tagged unions


def leading_tags(node: dict, graph: SchemaGraph | None = None) -> list[str]:
    if node.get("kind") == "ref" and graph is not None:
        node = graph.resolve(node)
    if "name" in node and not node.get("group_arm"):
        return [node["name"]]
    if node.get("kind") == "choice":
        return [t for a in node["arms"] for t in leading_tags(a["node"] if a.get("group_arm") else a, graph)]
    if node.get("kind") == "cat":
        if not node["parts"]:
            raise SchemaError("nothing-to-lead")
        first = node["parts"][0]
        return [first["name"]] if "name" in first else leading_tags(first["node"], graph)
    raise SchemaError("no-leading-tag", str(node.get("kind")))


def choice_to_union(node: dict, split: bool = False, graph: SchemaGraph | None = None) -> dict:
    """A choice as a union told apart by the first tag. An arm that opens with a choice is split into one branch a tag, where allowed."""
    if node.get("kind") != "choice":
        raise SchemaError("no-choice", str(node.get("kind")))
    branches: dict[str, dict] = {}
    for arm in node["arms"]:
        inner = arm["node"] if "name" not in arm or arm.get("group_arm") else None
        tags = leading_tags(inner, graph) if inner is not None else [arm["name"]]
        if len(tags) > 1 and not split:
            raise SchemaError("several-tags", ", ".join(tags))
        for t in tags:
            if t in branches:
                raise SchemaError("tag-twice", t)
            branches[t] = arm["node"] if inner is None else branch(inner, t, graph)
    return {"kind": "multi", "branches": branches}


def branch(node: dict, tag: str, graph: SchemaGraph | None = None) -> dict:
    """What is left of an arm once its first tag is known: the member with that tag, and all that follows the opening choice."""
    if node.get("kind") == "ref" and graph is not None:
        node = graph.resolve(node)
    if node["kind"] == "choice":
        arm = next(a for a in node["arms"] if tag in leading_tags(a if "name" in a and not a.get("group_arm") else a["node"], graph))
        return {"kind": "cat", "parts": [arm]} if "name" in arm and not arm.get("group_arm") else branch(arm["node"], tag, graph)
    if node["kind"] == "cat":
        first, *rest = node["parts"]
        head = [first] if "name" in first else branch(first["node"], tag, graph).get("parts", [])
        return {"kind": "cat", "parts": [*head, *rest]}
    return node


def dispatch(tag, branches: dict[str, object], otherwise=None):
    """A column by the tag of a choice: branches gives the column for each tag, as the union's dispatch does."""
    out = otherwise if otherwise is not None else F.lit(None)
    for name, c in sorted(branches.items()):
        out = F.when(tag == name, c).otherwise(out)
    return out


def unions_in(graph: SchemaGraph, keys: list[str], missing: str = "throw", split: bool = False) -> SchemaGraph:
    types = dict(graph.types)
    for k in keys:
        if k not in types:
            if missing == "skip":
                continue
            raise SchemaError("missing-key", k)
        types[k] = choice_to_union(types[k], split, graph)
    return SchemaGraph(types, graph.elements, graph.root, graph.closed, graph.bases)

"""Documents of a schema graph to typed structs, and back.

Two steps. *Shape*: one pass over each text, in Arrow batches, puts its elements where the graph says, as text: choices by their tag, ordered and
repeated groups as items in document order, derived types by xsi:type, open content as its XML. *Leaves*: column expressions, built from
the graph, decode that text by the leaf codecs. Writing is column expressions alone. What a node becomes:

* ``map``: a struct; attributes as ``_name``; a field that may repeat is an array (null if there is none)
* ``choice``: a struct of ``tag`` and one field for each arm; inside a map it is the field ``choice``
* ``cat`` (ordered or repeated content): an array of structs of ``ord``, ``tag`` and one field for each tag; runs of a choice's arms and of
  groups keep their order; ``_text`` where the item is text
* ``wrapped``: the attributes beside ``_VALUE`` (text), ``choice`` or ``items``
* ``list``: an array; ``union``: the text and the number of the member type that takes it; ``any``: inner XML; ``empty``: true

Reading is lenient: elements that the graph doesn't know are left out (``unread`` counts them), text that a leaf can't take is null. A malformed text gives a null value
and its ``error``; null texts give nulls. Recursion is unrolled ``depth`` times. An element whose tag occurs twice in one content with two
types is read by the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.leaf import decode_list, decode_union, leaf
from ..sinks.xml import escape as escape_column
from .xsd import SchemaGraph

XSI_TYPE = "{http://www.w3.org/2001/XMLSchema-instance}type"
TEXT = {"k": "text"}


class Shapes:
    """A plain tree of what is read where: small, and sent to the workers."""

    def __init__(self, graph: SchemaGraph, depth: int = 4):
        self.graph, self.depth = graph, depth

    def of(self, node: dict, path: tuple = ()) -> dict | None:
        kind = node["kind"]
        if kind == "ref":
            key = node["key"]
            if path.count(key) >= self.depth:
                return None
            out = self._derived(key, self.of(self.graph.node(key), (*path, key)), path)
            return out if out is None else {**out, "key": key}
        if kind == "leaf":
            return {"k": "text", "leaf": node["base"]}
        if kind == "list":
            return {"k": "text", "list": self.graph.resolve(node["item"]).get("base", "string")}
        if kind == "union":
            return {"k": "text", "union": [self.graph.resolve(m).get("base", "string") for m in node["members"]]}
        if kind == "any":
            return {"k": "xml"}
        if kind == "empty":
            return {"k": "flag"}
        out = {"k": "struct", "attrs": {}, "fields": {}, "choice": None, "items": None, "value": None, "order": []}
        self._content(node, out, path)
        return out

    def _derived(self, key: str, shape: dict | None, path: tuple) -> dict | None:
        """Types that extend ``key`` are read, too: their fields beside its own, told apart by ``_type``."""
        derived = {k: self.of(self.graph.node(k), (*path, key, k)) for k in self.graph.extensions(key) if path.count(k) < self.depth}
        if shape is None or shape["k"] != "struct" or not derived:
            return shape
        out = {**shape, "attrs": dict(shape["attrs"]), "fields": dict(shape["fields"]), "types": {key: self._names(shape)}}
        for k, other in derived.items():
            if other and other["k"] == "struct":
                out["types"][k] = self._names(other)
                out["attrs"] = other["attrs"] | out["attrs"]
                out["fields"] = other["fields"] | out["fields"]
                for part in ("choice", "items", "value"):
                    out[part] = out[part] or other[part]
        return out

    @staticmethod
    def _names(shape: dict) -> list[str]:
        return [f"@{a}" for a in shape["attrs"]] + list(shape["fields"])

    def _content(self, node: dict, out: dict, path: tuple) -> None:
        kind = node["kind"]
        if kind == "ref":
            inner = self.of(node, path)
            if inner is None:
                return
            if inner["k"] != "struct":
                out["value"] = inner
            else:
                for part in ("attrs", "fields"):
                    out[part] = inner[part] | out[part]
                for part in ("choice", "items", "value", "types"):
                    if inner.get(part):
                        out[part] = inner[part]
        elif kind == "map":
            for f in node["fields"]:
                if f.get("attr"):
                    out["attrs"].setdefault(f["name"], self.of(f["node"], path) or TEXT)
                elif f.get("inline") or (f["name"] == "choice" and f["node"]["kind"] == "choice"):
                    out["choice"] = self.arms(f["node"], path)
                else:
                    inner = self.of(f["node"], path)
                    if inner is not None:
                        out["fields"].setdefault(f["name"], {"shape": inner, "many": f.get("max", 1) != 1})
        elif kind == "wrapped":
            for f in node["attrs"]:
                out["attrs"].setdefault(f["name"], self.of(f["node"], path) or TEXT)
            self._content(node["value"], out, path)
        elif kind == "choice":
            out["choice"] = self.arms(node, path)
        elif kind == "cat":
            out["items"] = self.arms(node, path)
        else:
            out["value"] = self.of(node, path)

    def arms(self, node: dict, path: tuple) -> dict:
        """Shapes by tag of all elements that may stand in a content, those of its groups included."""
        out: dict[str, dict] = {}
        node = self.graph.resolve(node)
        for f in node.get("parts", node.get("arms", node.get("fields", []))):
            if f.get("attr"):
                continue
            inner = self.graph.resolve(f["node"])
            if "name" in f and not f.get("inline") and not f.get("group_arm"):
                shape = self.of(f["node"], path)
                if shape is not None:
                    out.setdefault(f["name"], shape)
            elif inner["kind"] in ("cat", "choice", "map"):
                for tag, shape in self.arms(inner, path).items():
                    out.setdefault(tag, shape)
        return out

    def element(self, key: str) -> dict:
        return self.of({"kind": "ref", "key": key}) or TEXT


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ET.Element) -> str | None:
    got = (e.text or "") + "".join(c.tail or "" for c in e)
    return got


def _inner(e: ET.Element) -> str:
    out = [escape(e.text or "")]
    for c in e:
        attrs = "".join(f" {_local(k)}={quoteattr(v)}" for k, v in c.attrib.items())
        body = _inner(c)
        out.append(f"<{_local(c.tag)}{attrs}>{body}</{_local(c.tag)}>" if body else f"<{_local(c.tag)}{attrs}/>")
        out.append(escape(c.tail or ""))
    return "".join(out)


class _Reader:
    def __init__(self):
        self.unread = 0

    def read(self, e: ET.Element, shape: dict, space: str):
        kind = shape["k"]
        if kind == "text":
            self.unread += len(e)
            return _text(e)
        if kind == "xml":
            return _inner(e)
        if kind == "flag":
            return True
        known = None
        out: dict = {}
        if shape.get("types"):
            out["_type"] = next(iter(shape["types"]))
            if e.get(XSI_TYPE):
                local = e.get(XSI_TYPE).rpartition(":")[2]
                tries = [e.get(XSI_TYPE), f"{out['_type'].rpartition('/')[0]}/{local}", f"{space}/{local}", *(k for k in shape["types"] if k.rpartition("/")[2] == local)]
                out["_type"] = next((t for t in tries if t in shape["types"]), out["_type"])
            known = set(shape["types"][out["_type"]])
        for name, value in e.attrib.items():
            local = _local(name)
            if local in shape["attrs"] and (known is None or f"@{local}" in known):
                out[f"_{local}"] = value
        items = []
        taken = False
        if shape["items"] is not None and e.text and e.text.strip():
            items.append({"ord": 1, "tag": None, "_text": e.text})
        for c in e:
            tag = _local(c.tag)
            if tag in shape["fields"] and (known is None or tag in known):
                f = shape["fields"][tag]
                value = self.read(c, f["shape"], space)
                if f["many"]:
                    out.setdefault(tag, []).append(value)
                else:
                    out[tag] = value
            elif shape["choice"] and tag in shape["choice"] and (not taken or out["choice"]["tag"] == tag):
                taken = True
                out["choice"] = {"tag": tag, tag: self.read(c, shape["choice"][tag], space)}
            elif shape["items"] and tag in shape["items"]:
                items.append({"ord": len(items) + 1, "tag": tag, tag: self.read(c, shape["items"][tag], space)})
            else:
                self.unread += 1
            if shape["items"] is not None and c.tail and c.tail.strip():
                items.append({"ord": len(items) + 1, "tag": None, "_text": c.tail})
        if items:
            out["items"] = items
        if shape["value"]:
            out["_VALUE"] = self.read(e, shape["value"], space) if shape["value"]["k"] != "text" else _text(e)
        return out


def _arms(shape: dict, of, head: list) -> list:
    return [*head, *((tag, of(arm)) for tag, arm in shape.items() if tag not in {n for n, _ in head})]


def text_type(shape: dict) -> T.DataType:
    if shape["k"] == "flag":
        return T.BooleanType()
    if shape["k"] != "struct":
        return T.StringType()
    string, integer = T.StringType(), T.IntegerType()
    fields: list[tuple[str, T.DataType]] = [("_type", string)] if shape.get("types") else []
    fields += [(f"_{a}", string) for a in shape["attrs"]]
    fields += [(n, T.ArrayType(text_type(f["shape"])) if f["many"] else text_type(f["shape"])) for n, f in shape["fields"].items()]
    if shape["choice"]:
        fields.append(("choice", T.StructType([T.StructField(n, k) for n, k in _arms(shape["choice"], text_type, [("tag", string)])])))
    if shape["items"] is not None:
        fields.append(("items", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in _arms(shape["items"], text_type, [("ord", integer), ("tag", string), ("_text", string)])]))))
    if shape["value"]:
        fields.append(("_VALUE", text_type(shape["value"])))
    if not fields:
        fields.append(("_empty", T.BooleanType()))
    return T.StructType([T.StructField(n, k) for n, k in fields])


def _each(c: Column, f) -> Column:
    return F.transform(c, lambda x: f(x))


def _decode(shape: dict, c: Column, hooks: dict | None = None) -> Column:
    out = _plain(shape, c, hooks or {})
    return hooks[shape["key"]](out) if hooks and shape.get("key") in hooks else out


def _plain(shape: dict, c: Column, hooks: dict) -> Column:
    if shape["k"] == "text":
        if "list" in shape:
            return decode_list(c, leaf(shape["list"]).decode)
        return decode_union(c, shape["union"]) if "union" in shape else leaf(shape.get("leaf", "string")).decode(c)
    if shape["k"] != "struct":
        return c
    parts = [c["_type"].alias("_type")] if shape.get("types") else []
    parts += [_decode(s, c[f"_{a}"], hooks).alias(f"_{a}") for a, s in shape["attrs"].items()]
    for name, f in shape["fields"].items():
        one = c[name]
        parts.append((_each(one, partial(_decode, f["shape"], hooks=hooks)) if f["many"] else _decode(f["shape"], one, hooks)).alias(name))
    if shape["choice"]:
        arms = [_decode(s, c["choice"][t], hooks).alias(t) for t, s in shape["choice"].items() if t != "tag"]
        parts.append(F.when(c["choice"].isNotNull(), F.struct(c["choice"]["tag"].alias("tag"), *arms)).alias("choice"))
    if shape["items"] is not None:
        heads = ("ord", "tag", "_text")
        parts.append(F.transform(c["items"], lambda x: F.struct(*[x[h].alias(h) for h in heads], *[_decode(s, x[t], hooks).alias(t) for t, s in shape["items"].items() if t not in heads])).alias("items"))
    if shape["value"]:
        parts.append(_decode(shape["value"], c["_VALUE"], hooks).alias("_VALUE"))
    if not parts:
        parts.append(c["_empty"].alias("_empty"))
    return F.when(c.isNotNull(), F.struct(*parts))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read(docs: DataFrame, graph: SchemaGraph, key: str | None = None, text_col: str = "text", depth: int = 4, namespace: str = "", hooks: dict | None = None) -> DataFrame:
    """hooks: for keys of types, a function from the decoded column to the one that takes its place. ``docs`` with ``value`` (typed), ``unread`` (elements without a place in the graph) and ``error`` in place of the text."""
    shape = Shapes(graph, depth).element(key or graph.root)
    kind = text_type(shape)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(kind)
        for batch in batches:
            texts = batch.column(text_col)
            lo = 0
            while lo < batch.num_rows:  # by size, so a batch of large documents is built in parts
                hi, size = lo, 0
                while hi < batch.num_rows and size < 1 << 20:
                    size += len(texts[hi].as_py() or "")
                    hi += 1
                values, unread, errors = [], [], []
                for t in texts.slice(lo, hi - lo).to_pylist():
                    reader, value, error = _Reader(), None, None
                    if t is not None:
                        try:
                            value = reader.read(ET.fromstring(t), shape, namespace)
                        except ET.ParseError as e:
                            error = str(e)
                    values.append(value)
                    unread.append(None if value is None else reader.unread)
                    errors.append(error)
                rest = [batch.column(c).slice(lo, hi - lo) for c in others]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(values, arrow), pa.array(unread, pa.int32()), pa.array(errors, pa.string())], [*others, "value", "unread", "error"])
                lo = hi

    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("value", kind), T.StructField("unread", T.IntegerType()), T.StructField("error", T.StringType())])
    got = docs.mapInArrow(run, schema)
    return got.withColumn("value", _decode(shape, F.col("value"), hooks))


# writing


def _encode(shape: dict, c: Column) -> Column:
    if "list" in shape:
        return F.array_join(F.transform(c, lambda x: leaf(shape["list"]).encode(x)), " ")
    if "union" in shape:
        return c["text"]
    return leaf(shape.get("leaf", "string")).encode(c)


def _element(tag: Column | str, shape: dict, c: Column) -> Column:
    """An element, or null where the value is."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    if shape["k"] == "flag":
        body, attrs = F.lit(""), F.lit("")
    elif shape["k"] == "text":
        body, attrs = escape_column(_encode(shape, c)), F.lit("")
    elif shape["k"] == "xml":
        body, attrs = c, F.lit("")
    else:
        pairs = [F.concat(F.lit(f" {a}=\""), escape_column(_encode(s, c[f"_{a}"]), True), F.lit('"')) for a, s in shape["attrs"].items()]
        if shape.get("types"):
            pairs.append(F.concat(F.lit(' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:type="'), F.element_at(F.split(c["_type"], "/"), -1), F.lit('"')))
        attrs = F.concat(F.lit(""), *[F.coalesce(p, F.lit("")) for p in pairs])
        inside = []
        for n, f in shape["fields"].items():
            one = c[n]
            inside.append(F.array_join(_each(one, partial(_element, n, f["shape"])), "") if f["many"] else _element(n, f["shape"], one))
        if shape["choice"]:
            inside.append(F.coalesce(*[F.when(c["choice"]["tag"] == t, _element(t, s, c["choice"][t])) for t, s in shape["choice"].items()]))
        if shape["items"] is not None:
            item = lambda x: F.coalesce(escape_column(x["_text"]), *[F.when(x["tag"] == t, _element(t, s, x[t])) for t, s in shape["items"].items()], F.lit(""))
            inside.append(F.array_join(F.transform(c["items"], item), ""))
        if shape["value"]:
            v = c["_VALUE"]
            inside.append(v if shape["value"]["k"] == "xml" else F.lit("") if shape["value"]["k"] == "flag" else escape_column(_encode(shape["value"], v)))
        body = F.concat(F.lit(""), *[F.coalesce(x, F.lit("")) for x in inside])
    return F.when(c.isNotNull(), F.concat(F.lit("<"), name, attrs, F.when(body == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), body, F.lit("</"), name, F.lit(">")))))


def write(value: Column, graph: SchemaGraph, key: str | None = None, depth: int = 4) -> Column:
    """XML text of a value that :func:`read` gave, or one of the same type; fields in the order of the graph, items in their own."""
    key = key or graph.root
    return _element(key.rpartition("/")[2], Shapes(graph, depth).element(key), value)


def content_model(graph: SchemaGraph, node: dict, path: tuple = ()) -> str:
    """A pattern of the tags that may follow each other, each in angle brackets: for ``array_join`` of tags and ``rlike``."""
    node = graph.resolve(node)

    def times(f: dict, body: str) -> str:
        lo, hi = f.get("min", 1), f.get("max", 1)
        return body if (lo, hi) == (1, 1) else f"(?:{body}){{{lo},{'' if hi is None else hi}}}"

    def part(f: dict) -> str:
        inner = graph.resolve(f["node"])
        if "name" in f and not f.get("inline") and not f.get("group_arm"):
            return times(f, f"(?:<{f['name']}>)")
        return times(f, "(?:" + content_model(graph, inner) + ")")

    kind = node["kind"]
    if kind == "wrapped":
        return content_model(graph, node["value"])
    if kind == "choice":
        arms = "|".join(f"(?:{part(f)})" for f in node["arms"])
        return f"(?:{arms})?" if node.get("min") == 0 else arms
    if kind in ("cat", "map"):
        return "".join(part(f) for f in node.get("parts", node.get("fields", [])) if not f.get("attr"))
    return "(?:<[^<>]*>)*" if kind == "any" else ""

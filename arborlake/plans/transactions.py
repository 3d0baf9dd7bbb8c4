"""X12 texts to typed transaction sets, and back, by the struct that the guide tables give.

Reading goes through the fields in guide order with one cursor over the segments: a segment field takes the segments of its tag, a loop field
opens where its first segment comes, and coded elements tell apart segments of one tag. Segments with a tag that the guide doesn't know,
those that come where nothing takes them, and elements beyond the known ones are kept in ``unread``. Elements are put in
their places as text, in Arrow batches; column expressions decode them by their element types. Writing is column expressions alone.

Null and empty texts give a null value; element text that its type can't take is null. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.leaf import encode_x12_date, encode_x12_integer, encode_x12_time, leaf
from ..sinks.x12 import joined
from ..sources.x12 import DEFAULTS, _cut_binary

UNREAD = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("elements", T.ArrayType(T.StringType()))]))


def _item(field: T.StructField) -> T.DataType:
    return field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType


def _plan(field: T.StructField) -> dict:
    kind = _item(field)
    out = {"name": field.name, "many": isinstance(field.dataType, T.ArrayType)}
    if "segment" in field.metadata:
        elements = []
        for e in kind.fields:
            inner = [(x.name, x.metadata["sequence"], x.metadata.get("codes")) for x in e.dataType.fields] if isinstance(e.dataType, T.StructType) else None
            elements.append((e.name, e.metadata["sequence"], e.metadata.get("codes"), inner))
        return out | {"tag": field.metadata["segment"], "elements": elements, "most": max([e[1] for e in elements], default=0)}
    return out | {"fields": [_plan(f) for f in kind.fields]}


def _prepare(plan: dict) -> frozenset:
    """Gives each field what the reader asks for at every segment: the segment that opens it and that one's coded elements. Returns all tags."""
    if "tag" in plan:
        plan["lead"] = plan
        plan["coded"] = [(place, frozenset(codes)) for _, place, codes, inner in plan["elements"] if inner is None and codes]
        return frozenset([plan["tag"]])
    tags = frozenset().union(*[_prepare(f) for f in plan["fields"]])
    plan["lead"] = plan["fields"][0]["lead"] if plan["fields"] else None
    plan["rests"] = {}
    return tags


class _Reader:
    def __init__(self, plan: dict, tags: frozenset, segments: list[list[str]], component: str):
        self.segments, self.component, self.at, self.unread = segments, component, 0, []
        self.plan, self.known = plan, tags
        self.tags = [s[0].strip() for s in segments]
        self.n = len(segments)

    def _keep(self, at: int, elements: list[str]) -> None:
        self.unread.append({"pos": at + 1, "tag": self.tags[at], "elements": elements})

    def _fits(self, p: dict) -> bool:
        at, known, tags = self.at, self.known, self.tags
        while at < self.n and tags[at] not in known:
            self._keep(at, self.segments[at][1:])
            at += 1
        self.at = at
        if at >= self.n:
            return False
        p = p["lead"]  # the segment that opens the loop
        if tags[at] != p["tag"]:
            return False
        if p["coded"]:
            s = self.segments[at]
            return all(place >= len(s) or not s[place] or s[place] in codes for place, codes in p["coded"])
        return True

    def _segment(self, p: dict) -> dict:
        s = self.segments[self.at]
        out, n = {}, len(s)
        for name, place, _, inner in p["elements"]:
            text = s[place] if place < n else ""
            if inner is None:
                out[name] = text or None
            elif text:
                parts = text.split(self.component)
                out[name] = {n: parts[k - 1] or None for n, k, _ in inner if k <= len(parts)}
        if n > p["most"] + 1 and any(s[p["most"] + 1 :]):
            self._keep(self.at, s[p["most"] + 1 :])
        self.at += 1
        return out

    def group(self, p: dict, after: frozenset = frozenset()) -> dict:
        """after: tags that may come once this instance has ended; what comes before one of them has no place here."""
        out: dict = {}
        rests = p["rests"].get(after)
        if rests is None:
            firsts = [f["lead"]["tag"] for f in p["fields"]]
            rests = p["rests"][after] = [after | set(firsts[k + 1 :]) | ({firsts[k]} if f["many"] else set()) for k, f in enumerate(p["fields"])]
        for f, rest in zip(p["fields"], rests, strict=True):
            values = []
            while self._fits(f):
                values.append(self._segment(f) if "tag" in f else self.group(f, rest))
                if not f["many"]:
                    break
            if values:
                out[f["name"]] = values if f["many"] else values[0]
        while self.at < self.n and self.tags[self.at] not in after:
            self._keep(self.at, self.segments[self.at][1:])
            self.at += 1
        return out

    def read(self) -> dict:
        return self.group(self.plan)


def _text_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text_type(f.dataType)) for f in kind.fields])
    return T.ArrayType(_text_type(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()


def _each(c: Column, f) -> Column:
    return F.transform(c, lambda x: f(x))


def _decode(field: T.StructField, c: Column) -> Column:
    kind = _item(field)
    if isinstance(kind, T.StructType):
        one = lambda x: F.when(x.isNotNull(), F.struct(*[_decode(f, x[f.name]).alias(f.name) for f in kind.fields]))
        return _each(c, one) if isinstance(field.dataType, T.ArrayType) else one(c)
    return leaf(f"x12:{field.metadata.get('type', 'AN')}").decode(c)


def read(docs: DataFrame, kind: T.StructType, text_col: str = "text") -> DataFrame:
    """``docs`` with ``value`` (typed) and ``unread`` in place of the text. kind: of an interchange or of a bare transaction set."""
    plan = {"fields": [_plan(f) for f in kind.fields]}
    shape = _text_type(kind)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow, arrow_unread = to_arrow_type(shape), to_arrow_type(UNREAD)
        tags = _prepare(plan)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                values, unread = [], []
                for t in part.column(text_col).to_pylist():
                    if not t or not t.strip():
                        values.append(None)
                        unread.append(None)
                        continue
                    isa = t.startswith("ISA") and len(t) > 105
                    element, component, terminator = (t[3], t[104], t[105]) if isa else (DEFAULTS[0], DEFAULTS[2], DEFAULTS[3])
                    r = _Reader(plan, tags, _cut_binary(t, element, terminator), component)
                    values.append(r.read())
                    unread.append(r.unread or None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(values, arrow), pa.array(unread, arrow_unread)], [*others, "value", "unread"])

    got = docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in others), T.StructField("value", shape), T.StructField("unread", UNREAD)]))
    return got.withColumn("value", _decode(T.StructField("value", kind), F.col("value")))


def _encode(field: T.StructField, c: Column, fixed: bool) -> Column:
    meta, name = field.metadata, field.metadata.get("type", "AN")
    least, most = meta.get("min") or 1, meta.get("max") or 0
    if name == "DT":
        return encode_x12_date(c, 6 if most and most < 8 else 8)
    if name == "TM":  # the shortest form that says as much
        size = F.when(~c.endswith("00"), 8).when(~F.substring(c, 7, 2).eqNullSafe("00"), 6).otherwise(4)
        return F.substring(encode_x12_time(c, 8), F.lit(1), F.greatest(size, F.lit(min(least, 8))))
    if name in ("N0", "N2"):
        return encode_x12_integer(c, least)
    text = leaf(f"x12:{name}").encode(c)
    return F.rpad(F.coalesce(text, F.lit("")), least, " ") if fixed else text


def _segment_text(field: T.StructField, c: Column, element: str, component: str) -> Column:
    tag = field.metadata["segment"]
    by_place: dict[int, Column] = {}
    for e in _item(field).fields:
        if isinstance(e.dataType, T.StructType):
            inner = {x.metadata["sequence"]: _encode(x, c[e.name][x.name], False) for x in e.dataType.fields}
            text = joined([inner.get(k, F.lit(None).cast("string")) for k in range(1, max(inner) + 1)], component)
        else:
            text = _encode(e, c[e.name], tag == "ISA")
        by_place[e.metadata["sequence"]] = text
    parts = [by_place.get(k, F.lit(None).cast("string")) for k in range(1, max(by_place, default=0) + 1)]
    return joined([F.lit(tag), *parts], element)


def _lines(field: T.StructField, c: Column, element: str, component: str) -> Column:
    """The segments of a field, in order, as an array of texts."""
    none = F.array().cast("array<string>")

    def one(x: Column) -> Column:
        if "segment" in field.metadata:
            return F.array(_segment_text(field, x, element, component))
        return F.concat(none, *[_lines(f, x[f.name], element, component) for f in _item(field).fields])

    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.flatten(_each(c, one)), none)
    return F.when(c.isNotNull(), one(c)).otherwise(none)


def write(value: Column, kind: T.StructType, element: str = "*", component: str = ":", terminator: str = "~", line: str = "") -> Column:
    """X12 text of a value of ``kind``; nulls are left out, and empty elements at the end of a segment."""
    lines = _lines(T.StructField("value", kind), value, element, component)
    return F.when(value.isNotNull(), F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit(terminator))), line))

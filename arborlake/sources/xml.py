"""XML text to tables.

``parse`` is the fast path for map-shaped types: Spark's own reader with a schema from the graph, limited to the fields asked for.
``nodes`` is the general one: a node table in document order, in which choice, interleaving, mixed text and recursion are
ordinary joins and windows. Preorder number and last descendant make ancestry a range condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSI = "http://www.w3.org/2001/XMLSchema-instance"
NODE_FIELDS = [("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_desc", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("ns", pa.string()), ("tag", pa.string()), ("value", pa.string()), ("xsi_type", pa.string()), ("error", pa.string())]
OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true", "mode": "PERMISSIVE"}


KINDS = ("elem", "attr", "text")
CHUNK = 1 << 16  #: characters of a text that go to the parser at once, and rows that wait for their element's end


def _checked(text: str) -> str | None:
    """The error of a malformed text. Nothing is kept."""
    p = expat.ParserCreate(namespace_separator="\x01")
    try:
        for lo in range(0, len(text), CHUNK):
            p.Parse(text[lo : lo + CHUNK], False)
        p.Parse("", True)
    except expat.ExpatError as e:
        return str(e)
    return None


class Shredder:
    """Nodes of one document. Comments and instructions are dropped, text around them is joined, white space between elements is
    dropped, external entities are never loaded. A malformed document gives one row with its error. Nodes of other kinds than ``kinds``
    are counted, not kept."""

    def __init__(self, kinds: tuple[str, ...] = KINDS):
        self.elements, self.attributes, self.texts = (k in kinds for k in KINDS)
        self.rows: list[list] = []
        self.n = 0  # nodes so far
        self.open: list[list] = []  # rows of open elements, kept or not
        self.count: list[int] = []  # children so far
        self.text: list[str] = []
        self.names: dict[str, tuple] = {}

    def _split(self, name: str) -> tuple:
        got = self.names.get(name)
        if got is None:
            ns, _, local = name.rpartition("\x01")
            got = self.names[name] = (ns or None, local)
        return got

    def _flush(self) -> None:
        text = self.text[0] if len(self.text) == 1 else "".join(self.text)
        self.text.clear()
        if self.open and not text.isspace():
            self.count[-1] += 1
            self.n += 1
            if self.texts:
                parent = self.open[-1]
                self.rows.append([self.n, parent[0], self.n, len(self.open), self.count[-1], "text", None, None, text, None, None, parent[7]])

    def start(self, name: str, attributes: list[str]) -> None:
        if self.text:
            self._flush()
        k = self.n = self.n + 1
        ns, tag = self.names.get(name) or self._split(name)
        if self.open:
            self.count[-1] += 1
            parent = self.open[-1]
            row = [k, parent[0], 0, len(self.open), self.count[-1], "elem", ns, tag, None, None, None, parent[7]]
        else:
            row = [k, None, 0, 0, 1, "elem", ns, tag, None, None, None, None]
        if self.elements:
            self.rows.append(row)
        self.open.append(row)
        self.count.append(0)
        if attributes:
            depth = len(self.open)
            for at in range(0, len(attributes), 2):
                name, value = attributes[at], attributes[at + 1]
                if name == f"{XSI}\x01type" and row[9] is None:
                    row[9] = value
                self.n += 1
                if self.attributes:
                    ns, own = self.names.get(name) or self._split(name)
                    self.rows.append([self.n, k, self.n, depth, 0, "attr", ns, own, value, None, None, tag])

    def end(self, name: str) -> None:
        if self.text:
            self._flush()
        self.open.pop()[2] = self.n
        self.count.pop()

    def _parser(self):
        p = expat.ParserCreate(namespace_separator="\x01")
        p.buffer_text = True
        p.ordered_attributes = True
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        p.CharacterDataHandler = self.text.append
        return p

    def pieces(self, text: str | None) -> Iterator[list[list]]:
        """The rows (NODE_FIELDS and the parent's tag) in pieces. A long text is checked first, then goes through in chunks, and rows leave as
        soon as they are known: what is held are the open elements and a chunk, whatever the document's size."""
        if text is None:
            return
        if len(text) <= CHUNK:
            try:
                self._parser().Parse(text, True)
            except expat.ExpatError as e:
                self.rows = [[None] * 10 + [str(e), None]]
            if self.rows:
                yield self.rows
            return
        if (error := _checked(text)) is not None:
            yield [[None] * 10 + [error, None]]
            return
        p = self._parser()
        for lo in range(0, len(text) + CHUNK, CHUNK):
            p.Parse(text[lo : lo + CHUNK], lo >= len(text))
            if len(self.rows) >= 1024:
                # open elements stay, without those that wait for their end already
                done = [r for r in self.rows if r[2]]
                self.rows[:] = [r for r in self.rows if not r[2]]
                if done:
                    yield done
        if self.rows:
            yield self.rows

    def read(self, text: str | None) -> list[list]:
        """Rows of NODE_FIELDS."""
        return [r[:-1] for piece in self.pieces(text) for r in piece]


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, node_id, parent_id, last_desc, depth, ord, kind, ns, tag, value, xsi_type, error). ``fields`` limits the columns to those that are
    used and may ask for parent_tag beside them; ``kinds`` limits the rows to nodes of these kinds, without the errors of malformed texts."""
    every = [*NODE_FIELDS, ("parent_tag", pa.string())]
    wanted = [k for k, (n, _) in enumerate(every) if (n in fields if fields is not None else n != "parent_tag")]
    keep = tuple(kinds) if kinds is not None else KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.field(id_col).type
            ids, counts, rows = [], [], []

            def out():
                places = pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), counts), pa.int32())
                got = pa.RecordBatch.from_arrays([pa.array(ids, of).take(places), *[pa.array([r[k] for r in rows], every[k][1]) for k in wanted]], [id_col, *[every[k][0] for k in wanted]])
                ids.clear(), counts.clear(), rows.clear()
                return got

            texts, names = batch.column(text_col), batch.column(id_col)
            for at in range(batch.num_rows):
                for piece in Shredder(keep).pieces(texts[at].as_py()):
                    if kinds is not None and piece[0][10] is not None:
                        continue
                    ids.append(names[at].as_py())
                    counts.append(len(piece))
                    rows += piece
                    if len(rows) >= 8192:
                        yield out()
            if rows:
                yield out()

    ints = {"node_id", "parent_id", "last_desc", "depth", "ord"}
    schema = T.StructType([docs.schema[id_col], *[T.StructField(every[k][0], T.IntegerType() if every[k][0] in ints else T.StringType()) for k in wanted]])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def descendants(table: DataFrame, ancestors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs (id, ancestor, node): nodes inside the ancestors (id, ancestor, first, last). An equi-join on the document, then a range."""
    return ancestors.join(table, id_col).where((F.col("node_id") > F.col("first")) & (F.col("node_id") <= F.col("last")))


def as_ancestors(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return elements.select(id_col, F.col("node_id").alias("ancestor"), F.col("node_id").alias("first"), F.col("last_desc").alias("last"))


def children(table: DataFrame, parents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Children (not attributes) of the parents (id, node_id), with their parent's number."""
    p = parents.select(F.col(id_col), F.col("node_id").alias("parent_id"))
    return table.where("kind <> 'attr'").join(p, [id_col, "parent_id"])


def text_of(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, node_id, text): direct text runs of each element, joined in order."""
    runs = table.where("kind = 'text'").groupBy(id_col, F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("_runs"))
    return runs.select(id_col, "node_id", F.array_join(F.transform("_runs", lambda r: r["value"]), "").alias("text"))


def attribute(table: DataFrame, name: str, alias: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, node_id, value) of an attribute; node_id is the element's."""
    return table.where((F.col("kind") == "attr") & (F.col("tag") == name)).select(id_col, F.col("parent_id").alias("node_id"), F.col("value").alias(alias or name))


def ordered_content(table: DataFrame, parents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, node_id, items: array<struct<ord, tag, value>>): the children of each parent in order, tags of text runs null."""
    kids = children(table, parents, id_col)
    text = text_of(table, id_col)
    kids = kids.join(text, [id_col, "node_id"], "left")
    item = F.struct("ord", "tag", F.when(F.col("kind") == "text", F.col("value")).otherwise(F.col("text")).alias("value"))
    return kids.groupBy(id_col, F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def parse(docs: DataFrame, schema: T.StructType, text_col: str = "text", fields: list[str] | None = None, **options: str) -> DataFrame:
    """Adds ``value``, a struct; ``fields`` limits the schema to what is read."""
    if fields is not None:
        schema = T.StructType([f for f in schema.fields if f.name in set(fields)])
    return docs.withColumn("value", F.from_xml(F.col(text_col), schema, OPTIONS | options))


def read(spark, path: str, schema: T.StructType, row_tag: str, **options: str) -> DataFrame:
    """Files whose rows are elements; large files are split at them. rowValidationXSDPath is passed through."""
    return spark.read.format("xml").options(rowTag=row_tag, **(OPTIONS | options)).schema(schema).load(path)


def resolve_xsi_type(name: Column, element_ns: Column, default_ns: Column, registry: Column) -> Column:
    """The first of three keys that is in ``registry`` (an array of keys): as written, in the element's namespace, in the default one."""
    local = F.element_at(F.split(name, ":"), -1)
    tries = [name, F.concat_ws("/", element_ns, local), F.concat_ws("/", default_ns, local)]
    return F.coalesce(*[F.when(F.array_contains(registry, t), t) for t in tries])

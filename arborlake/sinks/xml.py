"""Structs and node tables to XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}


def render(value: Column, row_tag: str, indent: bool = False, **options: str) -> Column:
    """XML of a struct column; nulls are left out."""
    text = F.to_xml(value, OPTIONS | {"rowTag": row_tag} | ({} if indent else {"indent": ""}) | options)
    return text if indent else F.rtrim(text, F.lit("\n"))


def write(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows", **options: str) -> None:
    df.write.format("xml").options(rowTag=row_tag, rootTag=root_tag, **(OPTIONS | options)).save(path)


def escape(c: Column, quote: bool = False) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *(((('"', "&quot;"),)) if quote else ())):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return F.replace(c, F.lit("\r"), F.lit("&#13;"))


def from_nodes(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of a node table, with one shuffle by document. Attributes follow their element, so a start tag ends where the next node
    isn't an attribute; an element closes after its last descendant, inner ones first. In documents with namespaces every element
    declares its own; attributes with one are written with a prefix."""
    w = Window.partitionBy(id_col).orderBy("node_id")
    ended = F.when(F.lead("kind").over(w) == "attr", "").otherwise(">")
    some = F.max(F.when(F.col("kind") == "elem", F.col("ns"))).over(Window.partitionBy(id_col)).isNotNull()
    declared = F.when(some, F.concat(F.lit(' xmlns="'), escape(F.coalesce("ns", F.lit("")), True), F.lit('"'))).otherwise("")
    prefix = F.when(F.col("ns").isNotNull(), F.concat(F.lit(' xmlns:a="'), escape(F.col("ns"), True), F.lit('" a:'))).otherwise(" ")
    text = F.when(F.col("kind") == "elem", F.concat(F.lit("<"), "tag", declared, ended))
    text = text.when(F.col("kind") == "attr", F.concat(prefix, "tag", F.lit('="'), escape(F.col("value"), True), F.lit('"'), ended)).otherwise(escape(F.col("value")))
    zero = F.lit(0)
    event = lambda at, last, inner, t: F.struct(at.alias("_at"), last.alias("_last"), inner.alias("_inner"), t.alias("_t"))
    opening = event(F.col("node_id"), zero, zero, F.col("_text"))
    closing = event(F.col("last_desc"), F.lit(1), -F.col("node_id"), F.concat(F.lit("</"), "tag", F.lit(">")))
    rows = nodes.where("error is null").withColumn("_text", text)
    events = rows.select(id_col, F.explode(F.when(F.col("kind") == "elem", F.array(opening, closing)).otherwise(F.array(opening))).alias("_e"))
    g = events.groupBy(id_col).agg(F.array_sort(F.collect_list("_e")).alias("_e"))
    return g.select(id_col, F.array_join(F.transform("_e", lambda e: e["_t"]), "").alias("text"))

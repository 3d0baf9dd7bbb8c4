"""Table functions for SQL: xml_nodes(text) and x12_segments(text)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.x12 import DEFAULTS, _cut_binary
from ..sources.xml import Shredder


@udtf(returnType="node_id int, parent_id int, last_desc int, depth int, ord int, kind string, ns string, tag string, value string, xsi_type string, error string")
class XmlNodes:
    def eval(self, text: str):
        for piece in Shredder().pieces(text):
            for row in piece:
                yield tuple(row[:-1])


@udtf(returnType="pos int, tag string, elements array<string>")
class X12Segments:
    def eval(self, text: str):
        if text is None:
            return
        isa = text.startswith("ISA") and len(text) > 105
        element, terminator = (text[3], text[105]) if isa else (DEFAULTS[0], DEFAULTS[3])
        for k, s in enumerate(_cut_binary(text, element, terminator)):
            yield k + 1, s[0].strip(), s[1:]


def register(spark: SparkSession) -> None:
    spark.udtf.register("xml_nodes", XmlNodes)
    spark.udtf.register("x12_segments", X12Segments)

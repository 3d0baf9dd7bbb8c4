"""Segment tables to X12 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed_join(parts: Column, separator: str) -> Column:
    """Parts with separators between; nulls are empty, empty parts at the end are left out."""
    text = F.array_join(parts, separator, "")
    return F.rtrim(text, F.lit(separator))


def joined(parts: list[Column], separator: str) -> Column:
    """As :func:`trimmed_join`, of a known number of parts: no array is made."""
    text = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.rtrim(text, F.lit(separator))


def composite(parts: list[Column], separator: str = ":") -> Column:
    return joined(parts, separator)


def segment(tag: str | Column, *elements: Column, separator: str = "*") -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return joined([tag, *elements], separator)


def render(segs: DataFrame, id_cols: list[str], order: list[str], elements: str = "elements", tag: str = "tag", element_sep: str = "*", terminator: str = "~") -> DataFrame:
    """(ids, text): the segments of each document in order."""
    line = F.concat(F.rtrim(F.array_join(F.concat(F.array(F.col(tag)), F.col(elements)), element_sep, ""), F.lit(element_sep)), F.lit(terminator))
    g = segs.select(*id_cols, F.struct(*order, line.alias("_line")).alias("_row")).groupBy(*id_cols).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    return g.select(*id_cols, F.array_join(F.col("_rows")["_line"], "").alias("text"))


def interchange_header(sender: Column, receiver: Column, date: Column, time: Column, control: Column, component_sep: str = ":", repeat_sep: str = "^", element_sep: str = "*") -> Column:
    """ISA with its fixed widths, up to the terminator."""
    return F.concat_ws(element_sep, F.lit("ISA"), F.lit("00"), F.lit(" " * 10), F.lit("00"), F.lit(" " * 10), F.lit("ZZ"), F.rpad(sender, 15, " "), F.lit("ZZ"), F.rpad(receiver, 15, " "), F.date_format(date, "yyMMdd"), time, F.lit(repeat_sep), F.lit("00501"), F.lpad(control.cast("string"), 9, "0"), F.lit("0"), F.lit("P"), F.lit(component_sep))

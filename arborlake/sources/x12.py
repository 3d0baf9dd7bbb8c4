"""X12 text to tables: segments, envelopes, loops, elements.

The delimiters stand at fixed places of the ISA segment. Texts are split by column expressions; binary payloads are taken by their
stated length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import number_all, number_instances

DELIMITERS = ("element_sep", "repeat_sep", "component_sep", "terminator")
DEFAULTS = ("*", "^", ":", "~")
SPACE = " \t\n\x0b\f\r"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def delimiters(text: Column) -> dict[str, Column]:
    """Element, repeat, component and segment delimiters. A text that doesn't open with ISA gets the usual ones; up to version 00401
    place 83 holds a standards letter, so there is no repeat delimiter."""
    isa = text.startswith("ISA")
    version = F.substring(text, 85, 5)
    at = lambda k: F.substring(text, k, 1)
    return {
        "element_sep": F.when(isa, at(4)).otherwise(DEFAULTS[0]),
        "repeat_sep": F.when(isa & ~at(83).rlike("[A-Za-z0-9 ]") & (version >= "00402"), at(83)).when(~isa, DEFAULTS[1]),
        "component_sep": F.when(isa, at(105)).otherwise(DEFAULTS[2]),
        "terminator": F.when(isa, at(106)).otherwise(DEFAULTS[3]),
    }


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def _pattern(c: Column) -> Column:
    """A delimiter as a pattern: one sign, escaped, is split at without a compiled pattern for each row."""
    plain = c.rlike(r"^[A-Za-z0-9]$")
    return F.when(plain, c).when(F.length(c) == 1, F.concat(F.lit("\\"), c)).otherwise(_quoted(c))


def _cut_binary(text: str, element: str, terminator: str) -> list[list[str]]:
    """Segments of a text in which BIN payloads may hold delimiters."""
    if "BIN" + element not in text and len(terminator) == 1 and terminator not in "\r\n\t ":
        pieces = [s.lstrip("\r\n\t ") for s in text.split(terminator)]
        if not pieces[-1]:
            pieces.pop()
        return [s.split(element) for s in pieces]
    out, at, n = [], 0, len(text)
    while at < n:
        while at < n and text[at] in "\r\n\t ":
            at += 1
        if at >= n:
            break
        if text.startswith("BIN" + element, at):
            a = at + 4
            b = text.find(element, a)
            if b > 0 and text[a:b].isdigit() and b + 1 + int(text[a:b]) <= n:
                end = b + 1 + int(text[a:b])
                out.append(["BIN", text[a:b], text[b + 1 : end]])
                at = end + len(terminator) if text.startswith(terminator, end) else end
                continue
        end = text.find(terminator, at)
        end = n if end < 0 else end
        out.append(text[at:end].split(element))
        at = end + len(terminator)
    return out


def _left(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def _joined_binary(parts: Column, element: Column, terminator: Column) -> Column:
    """Pieces between terminators, those of one BIN payload put together again by its stated length."""
    text = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), text.alias("held"), F.lit(0).alias("need"))

    def put(state: Column, piece: Column) -> Column:
        whole = F.when(state["held"].isNull(), _left(piece)).otherwise(F.concat(state["held"], terminator, piece))
        cut = F.split(whole, _quoted(element), 3)
        size = F.when(whole.startswith(F.concat(F.lit("BIN"), element)) & (F.size(cut) == 3), F.get(cut, F.lit(1)).try_cast("int"))
        need = F.when(state["held"].isNotNull(), state["need"]).otherwise(F.coalesce(F.length(F.get(cut, F.lit(1))) + 5 + size, F.lit(0)))
        short = F.length(whole) < need
        done = F.when(need == 0, F.array(whole)).otherwise(F.array(F.substring(whole, F.lit(1), need), _left(F.substring(whole, need + 1, F.length(whole)))))
        return F.struct(F.when(short, state["out"]).otherwise(F.concat(state["out"], done)).alias("out"), F.when(short, whole).alias("held"), F.when(short, need).otherwise(0).alias("need"))

    return F.aggregate(parts, start, put, lambda s: F.concat(s["out"], F.when(s["held"].isNotNull(), F.array(s["held"])).otherwise(F.array().cast("array<string>"))))


def segments(docs: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """(id, pos, tag, elements, repeat_sep, component_sep): a row for each segment, from 1. elements[0] is the first after the tag. One pass
    of column expressions; texts with BIN segments are put together again where a payload holds terminators."""
    d = delimiters(F.col(text_col))
    docs = docs.select(id_col, F.col(text_col).alias("_text"), *[c.alias(k) for k, c in d.items()], _pattern(d["element_sep"]).alias("_cut"))
    binary = F.concat(F.lit("BIN"), F.col("element_sep"))
    # white space after a terminator goes with it
    plain = F.array_remove(F.split(F.ltrim(F.col("_text"), F.lit(SPACE)), F.concat(_quoted(F.col("terminator")), F.lit(r"\s*")), -1), "")
    held = F.filter(_joined_binary(F.split(F.col("_text"), _quoted(F.col("terminator")), -1), F.col("element_sep"), F.col("terminator")), lambda s: s != "")
    parts = F.when(F.col("_text").contains(binary), held).otherwise(plain)
    rows = docs.select(id_col, "element_sep", "repeat_sep", "component_sep", "_cut", F.posexplode(parts).alias("_pos", "_seg"))
    # the tag is found without a cut at every separator, so segments are only cut where their elements are used
    cut = F.split("_seg", F.col("_cut"), F.when(F.col("_seg").startswith(binary), 3).otherwise(-1))
    tag = F.when(F.col("element_sep") != "", F.call_function("substring_index", "_seg", "element_sep", F.lit(1))).otherwise(cut[0])
    rows = rows.withColumn("_tag", F.trim(tag)).withColumn("_parts", cut)
    return rows.select(id_col, (F.col("_pos") + 1).alias("pos"), F.col("_tag").alias("tag"), F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))).alias("elements"), "repeat_sep", "component_sep")


def envelopes(segs: DataFrame, id_col: str = "file") -> DataFrame:
    """Adds isa, gs, st: running numbers of interchange, group and transaction set in the document."""
    return number_all(segs, {name: F.col("tag") == tag for name, tag in (("isa", "ISA"), ("gs", "GS"), ("st", "ST"))}, [id_col], ["pos"])


def element(k: int, elements: str | Column = "elements") -> Column:
    """The k-th element (from 1), null where it is missing or empty."""
    return F.nullif(F.get(F.col(elements) if isinstance(elements, str) else elements, F.lit(k - 1)), F.lit(""))


def components(value: Column, separator: Column) -> Column:
    """The parts of a composite; empty ones are null."""
    return F.transform(F.split(value, _quoted(separator), -1), lambda x: F.nullif(x, F.lit("")))


def repeats(value: Column, separator: Column) -> Column:
    return F.when(separator.isNull(), F.array(value)).otherwise(F.split(value, _quoted(separator), -1))


def loops(segs: DataFrame, start_tag: str, name: str, within: list[str], qualifier: tuple[int, str] | None = None) -> DataFrame:
    """Numbers the instances of a loop that opens with ``start_tag`` (and a qualifier value in an element); 0 before the first."""
    starts = F.col("tag") == start_tag
    if qualifier:
        starts = starts & (element(qualifier[0]) == qualifier[1])
    return number_instances(segs, starts, within, ["pos"], name)


def hierarchy(segs: DataFrame, within: list[str]) -> DataFrame:
    """(within, hl_id, parent_id, level_code, pos) of HL segments, with the position of the parent."""
    hl = segs.where("tag = 'HL'").select(*within, element(1).alias("hl_id"), element(2).alias("parent_id"), element(3).alias("level_code"), "pos")
    parent = hl.select(*within, F.col("hl_id").alias("parent_id"), F.col("pos").alias("parent_pos"), F.col("level_code").alias("parent_level"))
    return hl.join(parent, [*within, "parent_id"], "left")


def control_totals(segs: DataFrame, id_col: str = "file") -> DataFrame:
    """A row for each transaction set: segments counted and stated (SE01), and do they agree?"""
    st = envelopes(segs, id_col).where("st > 0").withColumn("_closed", F.max(F.when(F.col("tag") == "SE", F.col("pos"))).over(_per(id_col)))
    st = st.where((F.col("_closed").isNull()) | (F.col("pos") <= F.col("_closed")))
    g = st.groupBy(id_col, "st").agg(F.count("*").alias("counted"), F.max(F.when(F.col("tag") == "SE", element(1).try_cast("bigint"))).alias("stated"))
    return g.withColumn("agrees", F.col("counted").eqNullSafe(F.col("stated")))


def envelope_totals(segs: DataFrame, id_col: str = "file") -> DataFrame:
    """A row for each group (GE01: its transaction sets) and interchange (IEA01: its groups): level, isa, gs, counted, stated, agrees."""
    s = envelopes(segs, id_col)
    stated = lambda tag: F.max(F.when(F.col("tag") == tag, element(1).try_cast("bigint"))).alias("stated")
    counted = lambda tag: F.count(F.when(F.col("tag") == tag, 1)).alias("counted")
    # IEA stands in the last group's run; GE closes the group that it follows
    groups = s.where("gs > 0").groupBy(id_col, "isa", "gs").agg(counted("ST"), stated("GE")).withColumn("level", F.lit("GE"))
    whole = s.where("isa > 0").groupBy(id_col, "isa").agg(counted("GS"), stated("IEA")).withColumn("gs", F.lit(None).cast("bigint")).withColumn("level", F.lit("IEA"))
    every = groups.unionByName(whole).withColumn("agrees", F.col("counted").eqNullSafe(F.col("stated")))
    return every.select(id_col, "level", "isa", "gs", "counted", "stated", "agrees")


def previous_position(segs: DataFrame, id_col: str = "file") -> DataFrame:
    """Adds previous_pos: the position of the last segment of the same tag before this one in the document."""
    from pyspark.sql import Window

    return segs.withColumn("previous_pos", F.lag("pos").over(Window.partitionBy(id_col, "tag").orderBy("pos")))


def leftover(elements: Column, known: int) -> Column:
    """The elements beyond the known ones; null if there are none."""
    rest = F.slice(elements, F.lit(known + 1), F.greatest(F.size(elements) - known, F.lit(0)))
    return F.when(F.size(rest) > 0, rest)


def _per(id_col: str):
    from pyspark.sql import Window

    return Window.partitionBy(id_col, "st")


def nested(segs: DataFrame, id_col: str = "file") -> DataFrame:
    """One row for each document: interchanges with groups, with transaction sets, with ordered segments."""
    s = envelopes(segs, id_col).withColumn("segment", F.struct("pos", "tag", "elements"))
    outer = F.col("tag").isin("ISA", "GS", "GE", "IEA")
    listed = lambda c: F.sort_array(F.collect_list(c))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    # one pass: rows of the envelope and rows of transaction sets go up the same levels
    g = s.where(outer | (F.col("st") > 0)).groupBy(id_col, "isa", "gs", "st").agg(listed(F.when(~outer, F.col("segment"))).alias("segments"), F.collect_list(F.when(outer, F.col("segment"))).alias("envelope"))
    g = g.groupBy(id_col, "isa", "gs").agg(listed(F.when(F.size("segments") > 0, F.struct("st", "segments"))).alias("transaction_sets"), F.flatten(F.collect_list("envelope")).alias("envelope"))
    g = g.groupBy(id_col, "isa").agg(F.sort_array(F.flatten(F.collect_list("envelope"))).alias("envelope"), listed(F.when(F.size("transaction_sets") > 0, F.struct("gs", "transaction_sets"))).alias("functional_groups"))
    return g.groupBy(id_col).agg(listed(F.struct("isa", some("envelope").alias("envelope"), some("functional_groups").alias("functional_groups"))).alias("interchanges"))

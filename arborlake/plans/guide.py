"""X12 implementation-guide tables to schemas: ten header-less CSV tables of text, joined instead of searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import numbered, slug
from ..operators.sequences import at_most_one, first_known, last_wins, runs

#: The guide tables and their columns.
TABLES = {
    "SETHEAD": ["Transaction Set ID", "Transaction Set Name", "Functional Group ID"],
    "SETDETL": ["Set Transaction ID", "Area", "Sequence", "Segment ID", "Requirement", "Maximum Use", "Loop Level", "Loop Repeat", "Loop Identifier"],
    "SEGHEAD": ["Segment ID", "Segment Name"],
    "SEGDETL": ["Segment ID", "Sequence", "Data Element Number", "Requirement", "Repeat"],
    "COMHEAD": ["Composite Data Element Number", "Composite Name"],
    "COMDETL": ["Composite Data Element Number", "Sequence", "Data Element Number", "Requirement"],
    "ELEHEAD": ["Data Element Number", "Data Element Name"],
    "ELEDETL": ["Data Element Number", "Data Element Type", "Minimum Length", "Maximum Length"],
    "CONDETL": ["Record Type", "Transaction Set ID", "Area", "Sequence", "Segment ID", "Reference Designator", "Composite ID", "Composite Sequence", "Data Element Number", "Code", "Table", "Position", "Usage"],
    "CONTEXT": ["Record Type", "Transaction Set ID", "Area", "Sequence", "Segment ID", "Reference Designator", "Composite ID", "Composite Sequence", "Data Element Number", "Code", "Table", "Position", "Note Number", "Note Type", "Note"],
}
BROADCAST_BYTES = 64 << 20


def columns(name: str) -> list[str]:
    return [c.lower().replace(" ", "_") for c in TABLES[name]]


def schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns(name)])


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder (setdetl.txt, ...), columns in snake case; tables that aren't there are empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out = {}
    for name in TABLES:
        path = f"{folder}/{name.lower()}.txt"
        where = hadoop(path)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        if there:  # lines of a split are numbered in order, and splits by where they begin
            place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
            out[name] = spark.read.csv(path, header=False, schema=schema(name)).withColumn("_pos", place)
        else:
            out[name] = spark.createDataFrame([], schema(name))
    return out


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table that Spark's statistics bound; a larger one, or one of unknown size, is joined as Spark sees fit. Runs no job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _by_place(df: DataFrame) -> DataFrame:
    """A table with rows for each place grows with the guide, and a small file of it can be a large hash table: sorted and merged, never
    broadcast."""
    return df.hint("merge")


def _placed(df: DataFrame) -> DataFrame:
    """With _pos, the place of a row in its table: of its line where :func:`load` read it, else of the row as it comes."""
    return df if "_pos" in df.columns else df.withColumn("_pos", F.monotonically_increasing_id())


def element_types(spec: dict[str, DataFrame]) -> DataFrame:
    """ELEDETL with one row a number, the last one."""
    t = _placed(spec["ELEDETL"])
    return last_wins(t, ["data_element_number"], F.col("_pos")).drop("_pos")


def composites(spec: dict[str, DataFrame]) -> DataFrame:
    """(composite_data_element_number, items): its elements by sequence, in text order."""
    item = F.struct("sequence", "data_element_number", "requirement")
    return spec["COMDETL"].groupBy("composite_data_element_number").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _names(spec: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    ele = first_known(_placed(spec["ELEHEAD"]), ["data_element_number"], "data_element_name", F.col("_pos"))
    com = first_known(_placed(spec["COMHEAD"]), ["composite_data_element_number"], "composite_name", F.col("_pos"))
    return ele, com


def formats(kind: Column, least: Column, most: Column) -> Column:
    """Formats of dates and times by length, longest first."""
    sizes = F.reverse(F.sequence(least, most, F.lit(2)))
    date = F.transform(sizes, lambda n: F.when(n == 8, "yyyyMMdd").when(n == 6, "yyMMdd"))
    time = F.transform(sizes, lambda n: F.when(n == 8, "HHmmssSS").when(n == 6, "HHmmss").when(n == 4, "HHmm"))
    return F.when(kind == "DT", F.filter(date, lambda x: x.isNotNull())).when(kind == "TM", F.filter(time, lambda x: x.isNotNull()))


def _shape(df: DataFrame) -> DataFrame:
    least, most = F.col("minimum_length").cast("int"), F.col("maximum_length").cast("int")
    df = df.withColumn("min", least).withColumn("max", most).withColumn("formats", formats(F.col("data_element_type"), least, most))
    return df.withColumn("shift", F.when(F.col("data_element_type") == "N2", 100))


def plain_elements(spec: dict[str, DataFrame]) -> DataFrame:
    """Elements of every segment without a guide: a row for each element, or for each element of a composite."""
    ele, com = _names(spec)
    types = element_types(spec)
    seg = spec["SEGDETL"].select("segment_id", F.col("sequence").alias("element_sequence"), F.col("data_element_number").alias("number"))
    simple = seg.join(small(types), seg["number"] == types["data_element_number"]).drop("data_element_number")
    simple = simple.join(small(ele), simple["number"] == ele["data_element_number"], "left")
    simple = simple.select("segment_id", "element_sequence", F.lit(None).cast("string").alias("component_sequence"), "number", numbered(slug(F.col("data_element_name")), F.col("element_sequence")).alias("name"), "data_element_type", "minimum_length", "maximum_length")
    whole = seg.join(small(types), seg["number"] == types["data_element_number"], "left_anti")
    inside = _components(spec, whole, types, ele, com)
    return _shape(simple.unionByName(inside.select(simple.columns)))


def _components(spec, whole: DataFrame, types: DataFrame, ele: DataFrame, com: DataFrame) -> DataFrame:
    items = spec["COMDETL"].select(F.col("composite_data_element_number").alias("_composite"), F.col("sequence").alias("component_sequence"), F.col("data_element_number").alias("_inner"))
    inside = whole.join(small(items), F.col("number") == F.col("_composite"))
    inside = inside.join(small(types), F.col("_inner") == types["data_element_number"], "left").drop("data_element_number")
    inside = inside.join(small(ele), F.col("_inner") == ele["data_element_number"], "left").drop("data_element_number")
    inside = inside.join(small(com), F.col("_composite") == com["composite_data_element_number"], "left")
    return inside.withColumn("composite", numbered(slug(F.col("composite_name")), F.col("element_sequence"))).withColumn("name", numbered(slug(F.col("data_element_name")), F.col("component_sequence"))).withColumn("number", F.col("_inner"))


def kept_segments(spec: dict[str, DataFrame]) -> DataFrame:
    """Rows of SETDETL that the guide uses, with name, optional and repeated."""
    used = spec["CONDETL"].where("segment_id is null and usage is not null").select("area", "sequence").distinct()
    note = _placed(spec["CONTEXT"]).where("note_type = 'A' and record_type = 'B'")
    note = first_known(note, ["area", "sequence"], "note", F.col("_pos"))
    s = spec["SETDETL"].join(_by_place(used), ["area", "sequence"], "left_semi").join(_by_place(note), ["area", "sequence"], "left")
    return s.select("area", "sequence", "segment_id", F.coalesce(slug(F.col("note")), F.col("segment_id")).alias("segment_name"), (F.col("requirement") == "O").alias("optional"), (F.col("maximum_use") != "1").alias("repeated"), "loop_level", "loop_repeat", "loop_identifier")


def guide_elements(spec: dict[str, DataFrame]) -> DataFrame:
    """Elements of the segments that the guide uses, with guide names, usage and code lists; usage 8 is left out."""
    ele, com = _names(spec)
    types = element_types(spec)
    base = kept_segments(spec).select("area", "sequence", "segment_id", "segment_name")
    seg = spec["SEGDETL"].select("segment_id", F.col("sequence").alias("element_sequence"), F.col("data_element_number").alias("number"))
    # the elements of each segment first, once, then their places
    plain = seg.join(small(types), seg["number"] == types["data_element_number"]).drop("data_element_number")
    plain = plain.join(small(ele), plain["number"] == ele["data_element_number"], "left")
    plain = plain.withColumn("component_sequence", F.lit(None).cast("string")).withColumn("generic", F.col("data_element_name")).withColumn("composite", F.lit(None).cast("string"))
    whole = seg.join(small(types), seg["number"] == types["data_element_number"], "left_anti")
    inside = _components(spec, whole, types, ele, com).withColumn("generic", F.col("data_element_name"))
    keep = ["segment_id", "element_sequence", "component_sequence", "number", "generic", "composite", "data_element_type", "minimum_length", "maximum_length"]
    every = base.join(small(plain.select(keep).unionByName(inside.select(keep))), "segment_id")
    con = spec["CONDETL"].select("record_type", "area", "sequence", F.col("reference_designator").alias("element_sequence"), F.col("composite_sequence").alias("component_sequence"), "data_element_number", "code", "usage")
    whole_usage = at_most_one(con.where("record_type = 'C' and usage is not null"), ["area", "sequence", "element_sequence"], "usage").withColumnRenamed("usage", "_whole")
    part_usage = at_most_one(con.where("record_type = 'D' and usage is not null"), ["area", "sequence", "element_sequence", "component_sequence"], "usage").withColumnRenamed("usage", "_part")
    codes = con.where("record_type = 'E' and code is not null")
    by_number = codes.groupBy("area", "sequence", F.col("data_element_number").alias("number")).agg(F.array_sort(F.collect_set("code")).alias("_by_number"))
    by_part = codes.where("component_sequence is not null").groupBy("area", "sequence", "element_sequence", "component_sequence").agg(F.array_sort(F.collect_set("code")).alias("_by_part"))
    every = every.join(_by_place(whole_usage), ["area", "sequence", "element_sequence"], "left")
    # two joins on the same columns, rows dealt out once
    part = ["area", "sequence", "element_sequence", "component_sequence"]
    every = every.join(_by_place(part_usage), part, "left").join(_by_place(by_part), part, "left")
    every = every.withColumn("usage", F.when(F.col("component_sequence").isNull(), F.col("_whole")).otherwise(F.col("_part")))
    every = every.where((F.col("usage").isNull() | (F.col("usage") != "8")) & (F.col("component_sequence").isNull() | F.col("_whole").isNull() | (F.col("_whole") != "8")))
    note = spec["CONTEXT"].where("note_type = 'F' and note is not null").select("area", "sequence", F.col("reference_designator").alias("element_sequence"), F.col("composite_sequence").alias("_component"), F.col("note"))
    note = at_most_one(note, ["area", "sequence", "element_sequence", "_component"], "note")
    n = _by_place(note.withColumnRenamed("area", "_a").withColumnRenamed("sequence", "_s").withColumnRenamed("element_sequence", "_e"))
    every = every.join(n, (F.col("area") == F.col("_a")) & (F.col("sequence") == F.col("_s")) & (F.col("element_sequence") == F.col("_e")) & F.col("component_sequence").eqNullSafe(F.col("_component")), "left")
    every = every.join(_by_place(by_number), ["area", "sequence", "number"], "left")
    own = F.coalesce("component_sequence", "element_sequence")
    every = every.withColumn("name", numbered(slug(F.coalesce("note", "generic")), own)).withColumn("optional", ~F.coalesce(F.col("usage").isin("1", "5"), F.lit(False)))
    every = every.withColumn("codes", F.when(F.col("data_element_type") == "ID", F.when(F.col("component_sequence").isNull(), F.col("_by_number")).otherwise(F.col("_by_part"))))
    return _shape(every).select("area", "sequence", "segment_id", "segment_name", "element_sequence", "component_sequence", "composite", "number", "name", "optional", "data_element_type", "min", "max", "formats", "shift", "codes")


def loop_tree(spec: dict[str, DataFrame]) -> DataFrame:
    """Each row of SETDETL with its loop: the last header at its level or above, and that loop's parent header (by position)."""
    s = spec["SETDETL"].withColumn("level", F.col("loop_level").cast("int")).withColumn("header", F.col("loop_identifier").isNotNull())
    order = ["area", "sequence"]
    s = runs(s, F.col("level") > 0, ["set_transaction_id"], order, "area_run")
    w = Window.partitionBy("set_transaction_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("set_transaction_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("area", "sequence", "loop_identifier", "level")
    s = s.withColumn("_heads", F.collect_list(F.when(F.col("header"), place)).over(w)).withColumn("_before", F.collect_list(F.when(F.col("header"), place)).over(before))
    s = s.withColumn("loop", F.when(F.col("level") > 0, F.try_element_at(F.filter("_heads", lambda h: h["level"] == F.col("level")), F.lit(-1))))
    parent = F.try_element_at(F.filter("_before", lambda h: h["level"] == F.col("level") - 1), F.lit(-1))
    return s.withColumn("parent_loop", F.when(F.col("header") & (F.col("level") > 1), parent)).select("set_transaction_id", "area", "sequence", "segment_id", "level", "header", "area_run", F.col("loop")["loop_identifier"].alias("loop_id"), F.col("loop")["sequence"].alias("loop_sequence"), F.col("parent_loop")["loop_identifier"].alias("parent_loop_id"), "loop_repeat", "requirement")


X12_TYPES = {"ID": T.StringType(), "AN": T.StringType(), "DT": T.DateType(), "TM": T.StringType(), "R": T.DecimalType(38, 18), "N0": T.LongType(), "N2": T.LongType()}


def message_struct(spec: dict[str, DataFrame]) -> T.StructType:
    """The Spark type of a transaction set: segments and nested loops in guide order. Guide tables are small and read on the driver."""
    elements: dict[tuple, list] = {}
    for r in guide_elements(spec).orderBy("area", "sequence", "element_sequence", "component_sequence").collect():
        elements.setdefault((r.area, r.sequence), []).append(r)

    def segment(row) -> T.StructField:
        fields: dict[str, T.StructField] = {}
        for e in elements.get((row.area, row.sequence), []):
            f = T.StructField(e.name, X12_TYPES.get(e.data_element_type, T.StringType()), e.optional, {"sequence": int(e.component_sequence or e.element_sequence), "type": e.data_element_type, "min": e.min, "max": e.max, **({"codes": e.codes} if e.codes else {})})
            if e.component_sequence is None:
                fields[e.name] = f
            else:
                name = e.composite or f"composite-{e.element_sequence}"
                held = fields.get(name)
                fields[name] = T.StructField(name, T.StructType([*(held.dataType.fields if held else []), f]), True, {"sequence": int(e.element_sequence)})
        kind = T.StructType(list(fields.values()))
        return T.StructField(row.segment_name, T.ArrayType(kind) if row.repeated else kind, row.optional, {"segment": row.segment_id})

    rows = kept_segments(spec).orderBy("area", "sequence").collect()

    def build(rows: list, level: int) -> list[T.StructField]:
        out, k = [], 0
        while k < len(rows):
            r = rows[k]
            if r.loop_identifier and int(r.loop_level) > level:
                end = k + 1
                while end < len(rows) and int(rows[end].loop_level) >= int(r.loop_level) and not (rows[end].loop_identifier and int(rows[end].loop_level) == int(r.loop_level)):
                    end += 1
                kind = T.StructType([segment(r), *build(rows[k + 1 : end], int(r.loop_level))])
                out.append(T.StructField(r.loop_identifier, kind if r.loop_repeat == "1" else T.ArrayType(kind), r.optional, {"loop": r.loop_identifier}))
                k = end
            else:
                out.append(segment(r))
                k += 1
        return out

    return T.StructType(build(rows, 0))


def interchange_struct(spec: dict[str, DataFrame], transaction: T.DataType) -> T.StructType:
    """ISA, groups (GS, transaction sets, GE) and IEA around a transaction set."""
    by: dict[str, list] = {}
    names = {r.segment_id: r.segment_name for r in spec["SEGHEAD"].select("segment_id", slug(F.col("segment_name")).alias("segment_name")).collect()}
    for r in plain_elements(spec).where(F.col("segment_id").isin("ISA", "GS", "GE", "IEA")).orderBy("element_sequence").collect():
        by.setdefault(r.segment_id, []).append(T.StructField(r.name or f"{r.segment_id}{r.element_sequence}", X12_TYPES.get(r.data_element_type, T.StringType()), True, {"sequence": int(r.element_sequence), "type": r.data_element_type, "min": r.min, "max": r.max}))
    seg = lambda tag: T.StructField(names.get(tag, tag), T.StructType(by.get(tag, [])), True, {"segment": tag})
    group = T.StructType([seg("GS"), T.StructField("transaction-sets", T.ArrayType(transaction)), seg("GE")])
    return T.StructType([seg("ISA"), T.StructField("functional-groups", T.ArrayType(group)), seg("IEA")])

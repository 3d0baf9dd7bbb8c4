"""Queries of the schema-driven readers and writers, of guide tables with composites and codes, and of registries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import leaf, tables
from ..operators import graphs, sequences
from ..sinks import xml as xml_out
from ..sources import x12, xml
from . import guide, transactions, typed, xsd
from .queries import _JOINED, _geography, _read, interchanges, query

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:element name="event"><xs:complexType><xs:choice minOccurs="0"><xs:element name="low" type="xs:decimal"/><xs:element name="high" type="xs:decimal"/></xs:choice><xs:attribute name="id" type="xs:long"/></xs:complexType></xs:element>
<xs:complexType name="line"><xs:sequence><xs:element name="part" type="xs:long"/><xs:element name="quantity" type="xs:int"/></xs:sequence></xs:complexType>
<xs:element name="order"><xs:complexType><xs:choice maxOccurs="unbounded"><xs:element name="returned" type="line"/><xs:element name="kept" type="line"/></xs:choice><xs:attribute name="key" type="xs:long"/></xs:complexType></xs:element>
<xs:element name="leaves"><xs:complexType><xs:sequence><xs:element name="at" type="xs:dateTime"/><xs:element name="month" type="xs:gYearMonth"/><xs:element name="raw" type="xs:hexBinary"/><xs:element name="marks" type="xs:NMTOKENS"/>
<xs:element name="either"><xs:simpleType><xs:union memberTypes="xs:int xs:string"/></xs:simpleType></xs:element></xs:sequence><xs:attribute name="id" type="xs:long"/></xs:complexType></xs:element>
<xs:complexType name="node"><xs:sequence><xs:element name="child" type="node" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="id" type="xs:long"/></xs:complexType><xs:element name="tree" type="node"/>
<xs:complexType name="person"><xs:sequence><xs:element name="name" type="xs:string"/></xs:sequence><xs:attribute name="id" type="xs:long"/></xs:complexType>
<xs:complexType name="debtor"><xs:complexContent><xs:extension base="person"><xs:sequence><xs:element name="debt" type="xs:decimal"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:element name="people"><xs:complexType><xs:sequence><xs:element name="who" type="person" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>
<xs:element name="pairs"><xs:complexType><xs:sequence maxOccurs="unbounded"><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:int" minOccurs="0"/></xs:sequence></xs:complexType></xs:element>
</xs:schema>"""


def _graph() -> xsd.SchemaGraph:
    return xsd.loads(XSD, "q")


def _folder(spark, name: str) -> str:
    path = f"{graphs.scratch(spark)}/arborlake/{name}-{uuid.uuid4().hex}"
    graphs.until_exit(spark, path)
    return path


# typed XML


@query("select event_id, case when value is null then null when value < 60 then 'low' else 'high' end as tag, case when value < 60 then value::decimal(12,2) end as low, case when value >= 60 then value::decimal(12,2) end as high from events")
def xml_typed_choice(spark, d):
    arm = lambda tag: F.concat(F.lit(f"<{tag}>"), F.col("value").cast("decimal(12,2)"), F.lit(f"</{tag}>"))
    inner = F.when(F.col("value") < 60, arm("low")).when(F.col("value") >= 60, arm("high")).otherwise("")
    docs = _read(spark, d, "events").select("event_id", F.concat(F.lit('<event id="'), "event_id", F.lit('">'), inner, F.lit("</event>")).alias("text"))
    got = typed.read(docs, _graph(), "q/event").select("event_id", "value.choice")
    return got.select("event_id", "choice.tag", F.col("choice.low").cast("decimal(12,2)").alias("low"), F.col("choice.high").cast("decimal(12,2)").alias("high"))


@query("select l_orderkey as orderkey, string_agg(case when l_returnflag = 'R' then 'returned' else 'kept' end, ',' order by l_linenumber, l_partkey, l_returnflag = 'R') as tags, sum(case when l_returnflag = 'R' then l_quantity::int else 0 end)::bigint as returned, sum(case when l_returnflag = 'R' then 0 else l_quantity::int end)::bigint as kept from lineitem group by 1")
def xml_typed_repeated_choice(spark, d):
    tag = F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept")
    line = F.concat(F.lit("<"), tag, F.lit("><part>"), "l_partkey", F.lit("</part><quantity>"), F.col("l_quantity").cast("int"), F.lit("</quantity></"), tag, F.lit(">"))
    g = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("x")))).alias("x"))
    docs = g.select("l_orderkey", F.concat(F.lit('<order key="'), "l_orderkey", F.lit('">'), F.array_join(F.transform("x", lambda r: r["x"]), ""), F.lit("</order>")).alias("text"))
    v = typed.read(docs, _graph(), "q/order").select(F.col("value._key").alias("orderkey"), F.col("value.items").alias("items"))
    add = lambda arm: F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[arm]["quantity"], F.lit(0)))
    return v.select("orderkey", F.array_join(F.transform(F.array_sort("items", lambda a, b: a["ord"] - b["ord"]), lambda x: x["tag"]), ",").alias("tags"), add("returned").alias("returned"), add("kept").alias("kept"))


@query("select o_orderkey as orderkey, o_orderdate + interval 4 hour as ts, -14400 as offset_seconds, year(o_orderdate)::int as y, month(o_orderdate)::int as m, hex(encode(o_orderpriority)) as raw, len(list_filter(string_split(o_orderpriority, ' '), lambda x: x <> ''))::int as marks, case when o_orderkey % 2 = 0 then 0 else 1 end as member from orders")
def xml_typed_leaves(spark, d):
    o = _read(spark, d, "orders")
    either = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("word")
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    body = F.concat(part("at", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))), part("month", F.date_format("o_orderdate", "yyyy-MM")), part("raw", F.hex(F.col("o_orderpriority").cast("binary"))), part("marks", F.regexp_replace("o_orderpriority", " ", "   ")), part("either", either))
    docs = o.select(F.concat(F.lit('<leaves id="'), "o_orderkey", F.lit('">'), body, F.lit("</leaves>")).alias("text"))
    v = typed.read(docs, _graph(), "q/leaves").select("value.*")
    return v.select(F.col("_id").alias("orderkey"), F.col("at.ts").cast("timestamp_ntz").alias("ts"), F.col("at.offset_seconds").alias("offset_seconds"), F.col("month.year").alias("y"), F.col("month.month").alias("m"), F.hex("raw").alias("raw"), F.size("marks").alias("marks"), F.col("either.member").alias("member"))


@query("select 0 as depth, count(*) as n, sum(r_regionkey)::bigint as total from region union all select 1, count(*), sum(n_nationkey)::bigint from nation join region on n_regionkey = r_regionkey union all select 2, count(*), sum(c_custkey)::bigint from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def xml_typed_recursion(spark, d):
    c = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("_id")))).alias("child"))
    n = _read(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    n = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("_id"), "child"))).alias("child"))
    r = _read(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    docs = r.select(xml_out.render(F.struct(F.col("r_regionkey").alias("_id"), "child"), "tree").alias("text"))
    v = typed.read(docs, _graph(), "q/tree", depth=3).select("value.*")
    one = v.select(F.col("_id").alias("id"), F.lit(0).alias("depth"))
    two = v.select(F.explode("child").alias("c"))
    three = two.select(F.explode("c.child").alias("c"))
    every = one.unionByName(two.select(F.col("c._id").alias("id"), F.lit(1).alias("depth"))).unionByName(three.select(F.col("c._id").alias("id"), F.lit(2).alias("depth")))
    return every.groupBy("depth").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("select case when c_acctbal < 0 then 'q/debtor' else 'q/person' end as type, count(*) as n, sum(case when c_acctbal < 0 then c_acctbal::decimal(12,2) end)::decimal(38,2) as debt from customer group by 1")
def xml_typed_extension(spark, d):
    owes = F.col("c_acctbal") < 0
    who = F.concat(F.lit('<who id="'), "c_custkey", F.when(owes, '" xsi:type="debtor"><name>').otherwise('"><name>'), "c_name", F.lit("</name>"), F.when(owes, F.concat(F.lit("<debt>"), F.col("c_acctbal").cast("decimal(12,2)"), F.lit("</debt>"))).otherwise(""), F.lit("</who>"))
    docs = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit('<people xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'), F.array_join(F.collect_list(who), ""), F.lit("</people>")).alias("text"))
    w = typed.read(docs, _graph(), "q/people").select(F.explode("value.who").alias("w"))
    return w.groupBy(F.col("w._type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.col("w.debt").cast("decimal(12,2)")).cast("decimal(38,2)").alias("debt"))


@query("select l_orderkey as orderkey, md5('<order key=\"' || l_orderkey || '\">' || string_agg('<' || t || '><part>' || l_partkey || '</part><quantity>' || l_quantity::int || '</quantity></' || t || '>', '' order by l_linenumber, l_partkey, t, l_quantity::int) || '</order>') as digest from (select *, case when l_returnflag = 'R' then 'returned' else 'kept' end as t from lineitem) group by 1")
def xml_typed_write(spark, d):
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("quantity"))
    back = F.col("l_returnflag") == "R"
    item = F.struct(F.struct("l_linenumber", "l_partkey").alias("at"), F.lit(None).cast("string").alias("_text"), F.when(back, "returned").otherwise("kept").alias("tag"), F.when(back, line).alias("returned"), F.when(~back, line).alias("kept"))
    g = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    v = F.struct(F.col("l_orderkey").alias("_key"), F.col("items"))
    return g.select(F.col("l_orderkey").alias("orderkey"), F.md5(typed.write(v, _graph(), "q/order")).alias("digest"))


@query("select p_partkey as partkey, p_size % 4 <> 3 as valid from part")
def xml_content_model(spark, d):
    """(a, b?)+ : b alone at the front breaks it."""
    graph = _graph()
    size = F.col("p_size") % 4
    inner = F.when(size == 0, "<a>1</a>").when(size == 1, "<a>1</a><b>2</b>").when(size == 2, "<a>1</a><a>3</a><b>2</b>").otherwise("<b>2</b><a>1</a>")
    docs = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("<pairs>"), inner, F.lit("</pairs>")).alias("text"))
    tags = F.array_join(F.transform("value.items", lambda x: F.concat(F.lit("<"), x["tag"], F.lit(">"))), "")
    model = typed.content_model(graph, graph.node("q/pairs"))
    return typed.read(docs, graph, "q/pairs").select(F.col("p_partkey").alias("partkey"), tags.rlike(f"^(?:{model})$").alias("valid"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def xml_files_roundtrip(spark, d):
    """XML files out, rows back in by their tag."""
    where = _folder(spark, "xml-files")
    xml_out.write(_read(spark, d, "nation"), where, "nation")
    return xml.read(spark, where, T._parse_datatype_string("n_nationkey int, n_name string, n_regionkey int"), "nation")


@query("select r_regionkey::bigint as doc_id, 'nation' as tag, count(distinct n_nationkey) as n from region join nation on n_regionkey = r_regionkey group by 1 union all select r_regionkey, 'customer', count(c_custkey) from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1")
def xml_nodes_in_sql(spark, d):
    tables.register(spark)
    name = f"docs_{uuid.uuid4().hex}"
    _geography(spark, d).createOrReplaceTempView(name)
    return spark.sql(f"select doc_id, tag, count(*) as n from {name}, lateral xml_nodes(text) where kind = 'elem' and depth > 0 group by 1, 2")


@query("select 'N1' as tag, count(*) as n from nation union all select 'ST', count(*) from nation")
def x12_segments_in_sql(spark, d):
    tables.register(spark)
    name = f"docs_{uuid.uuid4().hex}"
    _read(spark, d, "nation").select(F.concat(F.lit("ST*1*"), "n_nationkey", F.lit("~N1*"), "n_name", F.lit("~")).alias("text")).createOrReplaceTempView(name)
    return spark.sql(f"select tag, count(*) as n from {name}, lateral x12_segments(text) group by 1")


# leaves


@query("select o_orderkey as orderkey, o_orderstatus = 'F' as flag, o_orderdate::date as day, strftime(o_orderdate, '%H:%M:%S') as clock, o_orderkey::bigint as whole, case when o_orderkey % 3 = 0 then null else (o_orderkey % 1000) end::int as year from orders")
def leaf_basic(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " True ").otherwise("1").alias("flag"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "HH:mm:ss").alias("clock"), F.when(F.col("o_orderkey") % 3 == 0, "12x").otherwise(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0")).alias("year"))
    of = lambda kind, c: leaf.leaf(kind).decode(F.col(c) if isinstance(c, str) else c)
    return o.select(F.col("o_orderkey").alias("orderkey"), of("boolean", "flag").alias("flag"), of("date", "day").alias("day"), of("time", "clock").alias("clock"), of("long", F.col("o_orderkey").cast("string")).alias("whole"), of("gYear", "year").alias("year"))


@query("select p_partkey as partkey, case when p_size % 4 = 0 then null else p_size * 12 end as months, p_size % 4 = 0 as refused, p_size % 3 = 0 as bad_base64 from part")
def leaf_out_of_range(spark, d):
    """Text that no type can hold is null and is told apart from missing text; no job fails."""
    period = F.when(F.col("p_size") % 4 == 0, "P99999999999Y").otherwise(F.concat(F.lit("P"), "p_size", F.lit("Y")))
    b64 = F.when(F.col("p_size") % 3 == 0, "AAAAA").otherwise("AQID")
    v = leaf.leaf("yearMonthDuration").decode(period)
    months = F.extract(F.lit("YEAR"), v).cast("int") * 12 + F.extract(F.lit("MONTH"), v).cast("int")
    return _read(spark, d, "part").select(F.col("p_partkey").alias("partkey"), months.alias("months"), leaf.undecoded("yearMonthDuration", period).alias("refused"), leaf.undecoded("base64Binary", b64).alias("bad_base64"))


@query("select l_orderkey as orderkey, l_linenumber as line, l_partkey as a, l_suppkey as b from lineitem")
def leaf_tuple(spark, d):
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), "l_partkey", F.lit("  "), "l_suppkey").alias("t"))
    v = leaf.decode_tuple(F.col("t"), ["long", "long"])
    return li.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), v["_1"].alias("a"), v["_2"].alias("b"))


# typed X12


def guide_850(spark) -> dict[str, DataFrame]:
    """A guide for the purchase orders that ``interchanges`` makes."""
    rows = {
        "SETDETL": ["850,1,010,ST,M,1,0,1,", "850,1,020,BEG,M,1,0,1,", "850,2,010,IT1,M,1,1,>1,IT1", "850,2,020,DTM,O,10,1,1,", "850,3,010,SE,M,1,0,1,"],
        "SEGHEAD": ["ISA,Interchange", "GS,Group", "GE,Group End", "IEA,Interchange End"],
        "SEGDETL": ["ST,01,143,M,1", "ST,02,329,M,1", "BEG,01,353,M,1", "BEG,02,92,M,1", "BEG,03,324,M,1", "BEG,04,328,O,1", "BEG,05,373,M,1", "IT1,01,350,O,1", "IT1,02,330,O,1", "IT1,03,355,O,1", "IT1,04,C1,O,1", "DTM,01,374,M,1", "DTM,02,373,O,1", "SE,01,96,M,1", "SE,02,329,M,1",
                    *(f"ISA,{k:02d},I{k:02d},M,1" for k in range(1, 17)), *(f"GS,{k:02d},G{k:02d},M,1" for k in range(1, 9)), "GE,01,97,M,1", "GE,02,28,M,1", "IEA,01,I17,M,1", "IEA,02,I18,M,1"],
        "COMHEAD": ["C1,Product"], "COMDETL": ["C1,01,235,M", "C1,02,234,M"],
        "ELEHEAD": ["143,Set", "329,Control", "353,Purpose", "92,Status", "324,Order", "328,Release", "373,Date", "350,Line", "330,Quantity", "355,Unit", "374,Qualifier", "96,Count", "235,Kind", "234,Part"],
        "ELEDETL": ["143,ID,3,3", "329,N0,4,9", "353,ID,2,2", "92,ID,1,2", "324,N0,9,22", "328,AN,1,30", "373,DT,6,8", "350,N0,1,20", "330,N0,1,15", "355,ID,2,2", "374,ID,3,3", "96,N0,1,10", "235,ID,2,2", "234,N0,1,48",
                    *(f"I{k:02d},AN,{n},{n}" for k, n in enumerate([2, 10, 2, 10, 2, 15, 2, 15, 6, 4, 1, 5, 9, 1, 1, 1], 1)), *(f"G{k:02d},AN,1,15" for k in range(1, 9)), "97,N0,1,6", "28,N0,1,9", "I17,N0,1,5", "I18,N0,9,9"],
        "CONDETL": [*(f"A,850,{a},{s},,,,,,,,,1" for a, s in (("1", "010"), ("1", "020"), ("2", "010"), ("2", "020"), ("3", "010"))), "E,850,1,020,BEG,01,,,353,00,,,", "E,850,1,020,BEG,01,,,353,05,,,"],
    }
    out = {}
    for name in guide.TABLES:
        kind = guide.schema(name)
        cut = [[x or None for x in r.split(",")] for r in rows.get(name, [])]
        out[name] = spark.createDataFrame([tuple(r + [None] * (len(kind) - len(r))) for r in cut], kind)
    return out


def _orders_kind(spark) -> T.StructType:
    spec = guide_850(spark)
    return guide.interchange_struct(spec, guide.message_struct(spec))


def _sets(spark, d) -> DataFrame:
    v = transactions.read(interchanges(spark, d), _orders_kind(spark))
    return v.select("doc_id", F.explode("value.functional-groups").alias("g")).select("doc_id", F.explode("g.transaction-sets").alias("t"))


@query(f"select o_orderkey as orderkey, o_orderstatus as status, count(*) as n_lines, sum(l_quantity::int)::bigint as quantity, sum(l_partkey)::bigint as parts, max(l_shipdate)::date as last_shipped, strptime('20' || strftime(o_orderdate, '%y%m%d'), '%Y%m%d')::date as day {_JOINED} group by 1, 2, 7")
def x12_typed_orders(spark, d):
    t = _sets(spark, d).select(F.col("t.BEG.order-03").alias("orderkey"), F.col("t.BEG.status-02").alias("status"), F.col("t.BEG.date-05").alias("day"), F.explode("t.IT1").alias("l"))
    t = t.select("*", F.array_max(F.transform("l.DTM", lambda x: x["date-02"])).alias("shipped"))
    return t.groupBy("orderkey", "status", "day").agg(F.count("*").alias("n_lines"), F.sum("l.IT1.quantity-02").alias("quantity"), F.sum("l.IT1.product-04.part-02").alias("parts"), F.max("shipped").alias("last_shipped"))


@query(f"select o_custkey as custkey, true as same {_JOINED} group by 1")
def x12_typed_write(spark, d):
    kind = _orders_kind(spark)
    docs = interchanges(spark, d)
    back = transactions.read(docs.withColumn("raw", F.col("text")), kind)
    text = transactions.write(F.col("value"), kind, line="\n")
    # the day of BEG05 is written in the longer form that its type allows
    plain = F.regexp_replace("raw", r"(BEG\*[^~]*\*)(\d{6})~", r"$120$2~")
    return back.select(F.col("doc_id").alias("custkey"), (plain == text).alias("same"))


@query(f"select o_custkey as custkey, 'DTM' as tag, count(*) as n {_JOINED} group by 1")
def x12_unread(spark, d):
    """Segments that the guide doesn't know are kept aside."""
    spec = guide_850(spark)
    spec["CONDETL"] = spec["CONDETL"].where("not (area = '2' and sequence = '020') or usage is null")
    kind = guide.interchange_struct(spec, guide.message_struct(spec))
    v = transactions.read(interchanges(spark, d), kind).select("doc_id", F.explode("unread").alias("u"))
    return v.groupBy(F.col("doc_id").alias("custkey"), F.col("u.tag").alias("tag")).agg(F.count("*").alias("n"))


@query(f"select o_custkey as custkey, 'GE' as level, count(distinct o_orderkey) as counted, count(distinct o_orderkey) as stated, true as agrees {_JOINED} group by 1 union all select o_custkey, 'IEA', 1, 1, true {_JOINED} group by 1")
def x12_envelope_totals(spark, d):
    t = x12.envelope_totals(x12.segments(interchanges(spark, d), "doc_id"), "doc_id")
    return t.select(F.col("doc_id").alias("custkey"), "level", "counted", "stated", "agrees")


@query(f"select o_custkey as custkey, count(*) - 1 as n, case when count(*) > 1 then 5 end as first {_JOINED} group by 1")
def x12_previous_position(spark, d):
    s = x12.previous_position(x12.segments(interchanges(spark, d), "doc_id"), "doc_id").where("tag = 'IT1'")
    return s.groupBy(F.col("doc_id").alias("custkey")).agg(F.count("previous_pos").alias("n"), F.min("previous_pos").alias("first"))


# guide tables with composites, codes and usages


def _composite_guide(spark, d) -> dict[str, DataFrame]:
    """Each part is a segment with one composite of its brand, whose two components have codes and a usage."""
    p = _read(spark, d, "part")
    out = {k: spark.createDataFrame([], guide.schema(k)) for k in guide.TABLES}
    seq = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    one = lambda name, source, **given: source.select(*[given.get(c, F.lit(None)).cast("string").alias(c) for c in guide.columns(name)])
    lit = F.lit
    brands = p.select("p_brand").distinct()
    out["SETDETL"] = one("SETDETL", p, set_transaction_id=lit("1"), area=lit("1"), sequence=seq, segment_id=F.col("p_brand"), requirement=lit("M"), maximum_use=lit("1"), loop_level=lit("0"), loop_repeat=lit("1"))
    out["SEGDETL"] = one("SEGDETL", brands, segment_id=F.col("p_brand"), sequence=lit("01"), data_element_number=F.concat(lit("C"), "p_brand"), requirement=lit("M"), repeat=lit("1"))
    out["COMHEAD"] = one("COMHEAD", brands, composite_data_element_number=F.concat(lit("C"), "p_brand"), composite_name=F.concat(lit("Of "), "p_brand"))
    both = brands.withColumn("k", F.explode(F.array(lit("01"), lit("02"))))
    out["COMDETL"] = one("COMDETL", both, composite_data_element_number=F.concat(lit("C"), "p_brand"), sequence=F.col("k"), data_element_number=F.concat(lit("E"), "k"), requirement=lit("M"))
    two = spark.createDataFrame([("E01", "ID"), ("E02", "AN")], "n string, t string")
    out["ELEDETL"] = one("ELEDETL", two, data_element_number=F.col("n"), data_element_type=F.col("t"), minimum_length=lit("1"), maximum_length=lit("5"))
    out["ELEHEAD"] = one("ELEHEAD", two, data_element_number=F.col("n"), data_element_name=F.concat(lit("Name "), "n"))
    place = {"area": lit("1"), "sequence": seq, "reference_designator": lit("01")}
    used = one("CONDETL", p, record_type=lit("A"), area=lit("1"), sequence=seq, usage=lit("1"))
    gone = one("CONDETL", p, record_type=lit("D"), segment_id=F.col("p_brand"), composite_sequence=lit("02"), usage=F.when(F.col("p_size") % 2 == 0, "8").otherwise("1"), **place)
    codes = one("CONDETL", p.withColumn("code", F.explode(F.array(F.col("p_size").cast("string"), lit("X"), lit("X")))), record_type=lit("E"), segment_id=F.col("p_brand"), composite_sequence=lit("01"), code=F.col("code"), data_element_number=lit("E01"), **place)
    out["CONDETL"] = used.unionByName(gone).unionByName(codes)
    return out


@query("select p_partkey as partkey, k as component, 'of-' || lower(p_brand) || '-01' as composite, 'name-e' || k || '-' || k as name, k <> '02' as optional, case when k = '01' then p_size || ',X' end as codes from part, (values ('01'), ('02')) v(k) where k = '01' or p_size % 2 = 1")
def guide_composites(spark, d):
    """Names from COMHEAD, components in order, their usage (8 leaves one out) and their code lists."""
    g = guide.guide_elements(_composite_guide(spark, d))
    return g.select(F.col("sequence").cast("bigint").alias("partkey"), F.col("component_sequence").alias("component"), "composite", "name", "optional", F.array_join("codes", ",").alias("codes"))


@query("select 'C' || p_brand as composite, 'E01,E02' as items from part group by 1")
def guide_components_in_order(spark, d):
    c = guide.composites(_composite_guide(spark, d))
    return c.select(F.col("composite_data_element_number").alias("composite"), F.array_join(F.transform("items", lambda x: x["data_element_number"]), ",").alias("items"))


@query("select n_nationkey::varchar as data_element_number, n_name as data_element_name from nation")
def guide_csv_load(spark, d):
    """Guide tables from files: columns by position, all text; tables that aren't there are empty."""
    where = _folder(spark, "guide")
    _read(spark, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name").write.csv(f"{where}/elehead.txt")
    spec = guide.load(spark, where)
    return spec["ELEHEAD"].drop("_pos").unionByName(spec["ELEHEAD"].drop("_pos").join(spec["SETHEAD"], F.lit(False), "left_semi"))


@query("select n_regionkey::varchar as set_transaction_id, n_nationkey::varchar as segment_id, case when n_nationkey % 5 = 0 then 'L' || n_nationkey end as opened, n_nationkey % 5 = 0 as header from nation")
def guide_loop_tree(spark, d):
    n = _read(spark, d, "nation")
    head = F.col("n_nationkey") % 5 == 0
    given = {"set_transaction_id": F.col("n_regionkey"), "area": F.lit("1"), "sequence": F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), "segment_id": F.col("n_nationkey"), "loop_level": F.lit("1"), "loop_identifier": F.when(head, F.concat(F.lit("L"), "n_nationkey")), "loop_repeat": F.lit("1"), "requirement": F.lit("M"), "maximum_use": F.lit("1")}
    t = guide.loop_tree({"SETDETL": n.select(*[given[c].cast("string").alias(c) for c in guide.columns("SETDETL")])})
    return t.select("set_transaction_id", "segment_id", F.when(F.col("header"), F.col("loop_id")).alias("opened"), "header")


# registries and rows


@query("select n_name as key, n_nationkey::varchar as form from nation where n_nationkey % 4 <> 0 or n_nationkey % 8 = 0")
def registry_own_entries(spark, d):
    """Entries that aren't builtins of the same form."""
    n = _read(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("form"), "n_nationkey")
    builtin = n.where("n_nationkey % 4 = 0").select("key", F.when(F.col("n_nationkey") % 8 == 0, "other").otherwise(F.col("form")).alias("form"))
    return graphs.own_entries(n.select("key", "form"), builtin)


@query("select n_nationkey as seed from nation where n_nationkey not in (select r_regionkey from region)")
def registry_missing_seeds(spark, d):
    return graphs.missing_seeds(_read(spark, d, "nation").select(F.col("n_nationkey").alias("seed")), _read(spark, d, "region").select(F.col("r_regionkey").alias("key")))


@query("select n_name as name from nation where n_nationkey % 3 = 0")
def registry_name_collisions(spark, d):
    n = _read(spark, d, "nation")
    return graphs.name_collisions(n.select(F.col("n_name").alias("name")).unionByName(n.where("n_nationkey % 3 = 0").select(F.concat("n_name", F.lit("-seq")).alias("name"))))


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def frequencies_above_one(spark, d):
    return sequences.frequencies(_read(spark, d, "events"), ["user_id", "event_type"])


@query("select o_orderkey as orderkey from orders order by o_orderkey offset 10 limit 30")
def rows_skip_and_take(spark, d):
    return sequences.rows_between(_read(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")), ["orderkey"], 10, 40)


@query("select user_id, max(event_id) filter (where event_type = 'click') as click, count(distinct event_type)::int as n from events group by 1")
def rows_as_map(spark, d):
    m = sequences.as_map(_read(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return m.select("user_id", F.try_element_at("entries", F.lit("click")).alias("click"), F.size("entries").alias("n"))


@query("select n_name as name, case when n_nationkey % 2 = 0 then 'int' else 'string' end as base, (n_nationkey % 2)::int as min from nation")
def xsd_fields_of_nations(spark, d):
    """A schema of one element for each nation, compiled and read back as a table."""
    rows = _read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    parts = "".join(f'<xs:element name="n{r.n_nationkey}" type="xs:{"string" if r.n_nationkey % 2 else "int"}" minOccurs="{r.n_nationkey % 2}"/>' for r in rows)
    g = xsd.loads(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="t"><xs:sequence>{parts}</xs:sequence></xs:complexType></xs:schema>', "k")
    f = xsd.SchemaGraph.from_json(g.to_json()).to_dataframes(spark)["xsd_fields"].where("key = 'k/t'")
    n = _read(spark, d, "nation").select("n_name", F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return f.join(n, "name").select(F.col("n_name").alias("name"), "base", "min")


@query("select p_brand as source, count(*) as n from part group by 1")
def xsd_refs_of_brands(spark, d):
    """Types that refer to each other: the rows of the reference table, and what a trimmed graph keeps."""
    rows = _read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand").collect()  # a few brands
    name = lambda b: "".join(c if c.isalnum() else "_" for c in b)
    types = "".join(f'<xs:complexType name="{name(r.p_brand)}"><xs:sequence><xs:element name="e" type="leaf{k}"/></xs:sequence></xs:complexType><xs:simpleType name="leaf{k}"><xs:restriction base="xs:string"/></xs:simpleType>' for k, r in enumerate(rows))
    g = xsd.loads(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{types}</xs:schema>', "b")
    refs = g.to_dataframes(spark)["xsd_refs"].select(F.substring_index("source", "/", -1).alias("key"))
    p = _read(spark, d, "part").select("p_brand", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("key"))
    return p.join(F.broadcast(refs), "key").groupBy(F.col("p_brand").alias("source")).agg(F.count("*").alias("n"))

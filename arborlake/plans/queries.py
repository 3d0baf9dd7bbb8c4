"""Queries over the driver's tables: each renders rows to XML or X12 text, reads the text back and computes on what it read; beside each,
the SQL over the base tables that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import leaf, names
from ..operators import graphs, sequences
from ..sinks import x12 as x12_out
from ..sinks import xml as xml_out
from ..sources import x12, xml
from . import guide, validate, xsd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _round_trip(df: DataFrame, row_tag: str, ddl: str) -> DataFrame:
    text = df.select(xml_out.render(F.struct(*df.columns), row_tag).alias("text"))
    return xml.parse(text, _struct(ddl)).select("value.*")


# XML


@query("select n_nationkey, n_name, n_regionkey from nation")
def xml_roundtrip_nation(spark, d):
    return _round_trip(_read(spark, d, "nation"), "nation", "n_nationkey int, n_name string, n_regionkey int")


@query("select c_custkey as custkey, c_mktsegment as segment, c_name as name from customer")
def xml_attr_value_customer(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("_segment"), F.col("c_name").alias("_VALUE"))
    got = _round_trip(c, "customer", "_id bigint, _segment string, _VALUE string")
    return got.select(F.col("_id").alias("custkey"), F.col("_segment").alias("segment"), F.col("_VALUE").alias("name"))


def _order_documents(spark, d) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("_n"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.col("l_returnflag").alias("flag"))
    g = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("line"))
    return g.select(F.col("l_orderkey").alias("doc_id"), xml_out.render(F.struct(F.col("l_orderkey").alias("_key"), "line"), "order").alias("text"))


ORDER = "_key bigint, line array<struct<_n: int, part: bigint, quantity: decimal(12,2), flag: string>>"


@query("select l_orderkey as orderkey, count(*) as n_lines, sum(l_quantity::decimal(12,2)) as quantity from lineitem group by 1")
def xml_repeat_order_lines(spark, d):
    got = xml.parse(_order_documents(spark, d), _struct(ORDER)).select(F.col("value._key").alias("orderkey"), F.explode("value.line").alias("l"))
    return got.groupBy("orderkey").agg(F.count("*").alias("n_lines"), F.sum("l.quantity").cast("decimal(38,2)").alias("quantity"))


@query("select c_custkey as custkey, case when c_acctbal > 0 then c_name end as name, c_acctbal > 0 as given from customer")
def xml_optional_missing(spark, d):
    c = _read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("c_name"))
    got = _round_trip(c, "customer", "c_custkey bigint, c_name string")
    return got.select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_name").isNotNull().alias("given"))


@query("select event_id, ts, 0 as offset_seconds from events")
def xml_datetime_events(spark, d):
    e = _read(spark, d, "events").select("event_id", F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z")).alias("ts"))
    got = _round_trip(e, "event", "event_id bigint, ts string").withColumn("t", leaf.decode_date_time(F.col("ts")))
    return got.select("event_id", F.col("t.ts").cast("timestamp_ntz").alias("ts"), "t.offset_seconds")


@query("select l_returnflag as flag, sum(l_extendedprice::decimal(18,2)) as price, count(*) as n from lineitem group by 1")
def xml_decimal_agg(spark, d):
    line = _read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    got = _round_trip(line, "line", "l_returnflag string, price decimal(18,2)")
    return got.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("price").cast("decimal(38,2)").alias("price"), F.count("*").alias("n"))


@query("select event_type as tag, count(*) as n, min(event_id) as first_id from events group by 1")
def xml_choice_dispatch_events(spark, d):
    e = _read(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("<event><"), "event_type", F.lit(">"), "event_id", F.lit("</"), "event_type", F.lit("></event>")).alias("text"))
    n = xml.nodes(e).where("kind = 'elem' and depth = 1")
    return n.groupBy("tag").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as n from conversations group by 1")
def xml_ordered_cat_conversations(spark, d):
    t = _read(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    one = F.concat(F.lit("<"), "role", F.lit(">"), xml_out.escape(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "")), F.lit("</"), "role", F.lit(">"))
    docs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))).alias("t"))
    docs = docs.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("<c>"), F.array_join(F.transform("t", lambda x: x["x"]), ""), F.lit("</c>")).alias("text"))
    n = xml.nodes(docs)
    items = xml.ordered_content(n, n.where("depth = 0 and kind = 'elem'"))
    return items.select(F.col("doc_id").alias("conv_id"), F.array_join(F.transform("items", lambda x: x["tag"]), ",").alias("roles"), F.size("items").cast("long").alias("n"))


CLEAN = r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f]"


@query("select doc_id, length(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0d\\x0e-\\x1f]', '', 'g')) as n_chars from documents")
def xml_mixed_documents(spark, d):
    docs = _read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.regexp_replace("text", CLEAN, "")
    half = F.floor(F.length(text) / 2).cast("int")
    mixed = F.concat(F.lit("<p>"), xml_out.escape(F.substring(text, F.lit(1), half)), F.lit("<!-- cut --><b/>"), xml_out.escape(F.substring(text, half + 1, F.length(text))), F.lit("</p>"))
    n = xml.nodes(docs.select("doc_id", mixed.alias("text")))
    whole = n.where("kind = 'text'").groupBy("doc_id").agg(F.sum(F.length("value")).alias("kept"))
    blank = docs.select("doc_id", F.length(text).alias("n"), *[F.when(~part.rlike(r"\S"), F.length(part)).otherwise(0).alias(k) for k, part in (("a", F.substring(text, F.lit(1), half)), ("b", F.substring(text, half + 1, F.length(text))))])
    return blank.join(whole, "doc_id", "left").select("doc_id", (F.coalesce("kept", F.lit(0)) + F.col("a") + F.col("b")).cast("long").alias("n_chars"))


@query("select 'elem' as kind, 'order' as tag, count(distinct l_orderkey) as n from lineitem union all select 'elem', t, count(*) from lineitem, (values ('line'), ('part'), ('quantity'), ('flag')) v(t) group by 2 union all select 'attr', 'key', count(distinct l_orderkey) from lineitem union all select 'attr', 'n', count(*) from lineitem")
def xml_node_table_counts(spark, d):
    n = xml.nodes(_order_documents(spark, d), fields=["kind", "tag"], kinds=("elem", "attr"))
    return n.groupBy("kind", "tag").agg(F.count("*").alias("n"))


def _geography(spark, d) -> DataFrame:
    c = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("_id")))).alias("customer"))
    n = _read(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    n = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("_id"), "customer"))).alias("nation"))
    r = _read(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), xml_out.render(F.struct(F.col("r_name").alias("_name"), "nation"), "region").alias("text"))


@query("select r_regionkey::bigint as doc_id, n_nationkey as nation, count(c_custkey) as n_customers from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2")
def xml_ancestor_range(spark, d):
    n = xml.nodes(_geography(spark, d), fields=["kind", "tag", "node_id", "parent_id", "last_desc", "value"], kinds=("elem", "attr"))
    nations = n.where("kind = 'elem' and tag = 'nation'")
    inside = xml.descendants(n.where("kind = 'elem' and tag = 'customer'"), xml.as_ancestors(nations)).groupBy("doc_id", "ancestor").count()
    ids = xml.attribute(n, "id").select("doc_id", F.col("node_id").alias("ancestor"), F.col("id").cast("int").alias("nation"))
    named = nations.select("doc_id", F.col("node_id").alias("ancestor")).join(ids, ["doc_id", "ancestor"])
    return named.join(inside, ["doc_id", "ancestor"], "left").select("doc_id", "nation", F.coalesce("count", F.lit(0)).cast("long").alias("n_customers"))


@query("select 0 as depth, count(*) as n from region union all select 1, count(*) from nation join region on n_regionkey = r_regionkey union all select 2, count(*) from customer join nation on c_nationkey = n_nationkey")
def xml_recursive_depth(spark, d):
    return xml.nodes(_geography(spark, d), fields=["depth"], kinds=("elem",)).groupBy("depth").agg(F.count("*").alias("n"))


@query("select l_orderkey as doc_id, count(*) as n from lineitem where l_returnflag = 'R' group by 1")
def xml_unknown_child_antijoin(spark, d):
    line = F.concat(F.lit("<line><part>1</part>"), F.when(F.col("l_returnflag") == "R", "<odd/>").otherwise(""), F.lit("</line>"))
    docs = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<order>"), F.array_join(F.collect_list(line), ""), F.lit("</order>")).alias("text")).select(F.col("l_orderkey").alias("doc_id"), "text")
    allowed = spark.createDataFrame([("order", "line"), ("line", "part")], "parent string, tag string")
    return validate.unexpected_children(xml.nodes(docs, fields=["kind", "tag", "parent_tag"], kinds=("elem",)), allowed).groupBy("doc_id").agg(F.count("*").alias("n"))


XSD_CUSTOMER = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="customer"><xs:complexType><xs:sequence>
<xs:element name="name" minOccurs="1"><xs:simpleType><xs:restriction base="xs:string"><xs:minLength value="1"/><xs:maxLength value="16"/></xs:restriction></xs:simpleType></xs:element>
<xs:element name="segment"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="BUILDING"/><xs:enumeration value="MACHINERY"/></xs:restriction></xs:simpleType></xs:element>
<xs:element name="code"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="C-[0-9]*[05]"/></xs:restriction></xs:simpleType></xs:element>
</xs:sequence><xs:attribute name="id" type="xs:long" use="required"/></xs:complexType></xs:element></xs:schema>"""


@query("select c_custkey as custkey, case when c_acctbal < 0 then 1 else 0 end as missing, case when length(c_name) > 16 and c_acctbal >= 0 then 1 else 0 end as long_name, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 1 else 0 end as odd_segment, case when c_custkey % 5 <> 0 then 1 else 0 end as odd_code from customer")
def xml_facets_and_required(spark, d):
    g = xsd.loads(XSD_CUSTOMER, "c")
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("C-"), "c_custkey").alias("code"))
    text = c.select(xml_out.render(F.struct(*c.columns), "customer").alias("text"))
    got = xml.parse(text, g.to_struct("c/customer", typed_attributes=True)).withColumn("v", validate.violations(g, F.col("value"), "c/customer"))
    has = lambda what: F.exists("v", lambda x: x.contains(what)).cast("int")
    return got.select(F.col("value._id").alias("custkey"), has("required").alias("missing"), has("too long").alias("long_name"), has("enumeration").alias("odd_segment"), has("pattern").alias("odd_code"))


@query("select l_orderkey as doc_id, count(*) as n from lineitem group by 1 having count(*) not between 2 and 4")
def xml_occurs_bounds(spark, d):
    return validate.occurrence_bounds(xml.nodes(_order_documents(spark, d), fields=["kind", "tag", "node_id", "parent_id"], kinds=("elem",)), "order", "line", 2, 4).select("doc_id", F.col("n").cast("long").alias("n"))


@query("select n_nationkey as id, case when n_nationkey % 3 = 0 then 'a/T0' when n_nationkey % 3 = 1 then 'b/T1' end as resolved from nation")
def xml_xsi_type_resolve(spark, d):
    text = F.concat(F.lit('<i xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:type="T'), F.col("n_nationkey") % 3, F.lit('"/>'))
    n = xml.nodes(_read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), text.alias("text"))).where("kind = 'elem'")
    known = F.array(F.lit("a/T0"), F.lit("b/T1"))
    return n.select(F.col("doc_id").alias("id"), xml.resolve_xsi_type(F.col("xsi_type"), F.lit("a"), F.lit("b"), known).alias("resolved"))


@query("select p_partkey as partkey, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) as n, case when try_cast(p_size as int) is not null then 0 end as member from part")
def xml_list_and_union(spark, d):
    p = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.regexp_replace("p_type", " ", "   ")).alias("p_type"), F.col("p_size").cast("string").alias("p_size"))
    got = _round_trip(p, "part", "p_partkey bigint, p_type string, p_size string")
    return got.select(F.col("p_partkey").alias("partkey"), F.size(leaf.decode_list(F.col("p_type"))).cast("long").alias("n"), leaf.decode_union(F.col("p_size"), ["int", "string"])["member"].alias("member"))


@query("select p_partkey as partkey, to_base64(encode(p_name)) as b64, hex(encode(p_name)) as hexed, true as same from part")
def leaf_base64_hex(spark, d):
    p = _read(spark, d, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("b64"), F.hex(F.col("p_name").cast("binary")).alias("hexed"), "p_name")
    got = _round_trip(p, "part", "p_partkey bigint, b64 string, hexed string, p_name string")
    a, b = leaf.leaf("base64Binary"), leaf.leaf("hexBinary")
    same = (a.decode(F.col("b64")) == F.col("p_name").cast("binary")) & (b.decode(F.col("hexed")) == F.col("p_name").cast("binary"))
    return got.select(F.col("p_partkey").alias("partkey"), a.encode(a.decode(F.col("b64"))).alias("b64"), b.encode(b.decode(F.col("hexed"))).alias("hexed"), same.alias("same"))


@query("select p_partkey as partkey, p_size * 60 as seconds, case when p_size = 0 then 'PT0S' when p_size % 60 = 0 then 'PT' || (p_size // 60) || 'H' when p_size < 60 then 'PT' || p_size || 'M' else 'PT' || (p_size // 60) || 'H' || (p_size % 60) || 'M' end as text from part")
def leaf_duration(spark, d):
    p = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("PT"), "p_size", F.lit("M")).alias("span"))
    got = _round_trip(p, "part", "p_partkey bigint, span string").withColumn("v", leaf.decode_duration(F.col("span")))
    secs = F.extract(F.lit("DAY"), F.col("v")) * 86400 + F.extract(F.lit("HOUR"), F.col("v")) * 3600 + F.extract(F.lit("MINUTE"), F.col("v")) * 60 + F.extract(F.lit("SECOND"), F.col("v"))
    return got.select(F.col("p_partkey").alias("partkey"), secs.cast("int").alias("seconds"), leaf.encode_duration(F.col("v")).alias("text"))


@query("select o_orderkey as orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, strftime(o_orderdate, '%Y-%m') as year_month, strftime(o_orderdate, '--%m-%d') as month_day from orders")
def leaf_partial_dates(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.date_format("o_orderdate", "'--'MM-dd").alias("md"))
    got = _round_trip(o, "order", "o_orderkey bigint, ym string, md string").withColumn("a", leaf.decode_year_month(F.col("ym"))).withColumn("b", leaf.decode_month_day(F.col("md")))
    return got.select(F.col("o_orderkey").alias("orderkey"), F.col("a.year").alias("y"), F.col("b.month").alias("m"), leaf.encode_year_month(F.col("a")).alias("year_month"), leaf.encode_month_day(F.col("b")).alias("month_day"))


@query("select l_orderkey as doc_id, md5('<order key=\"' || l_orderkey || '\">' || string_agg('<line n=\"' || l_linenumber || '\"><part>' || l_partkey || '</part></line>', '' order by l_linenumber, l_partkey) || '</order>') as digest from lineitem group by l_orderkey")
def xml_node_table_writer(spark, d):
    line = F.struct(F.col("l_linenumber").alias("_n"), F.col("l_partkey").alias("part"))
    g = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("line"))
    docs = g.select(F.col("l_orderkey").alias("doc_id"), xml_out.render(F.struct(F.col("l_orderkey").alias("_key"), "line"), "order", indent=True).alias("text"))
    return xml_out.from_nodes(xml.nodes(docs, fields=["kind", "ns", "tag", "value", "node_id", "last_desc", "error"])).select("doc_id", F.md5("text").alias("digest"))


@query("select page_id, page_id % 2 = 1 as broken from pages")
def xml_malformed_pages(spark, d):
    """Pages as text of an element that is never closed on odd ids: an error row, and no failure."""
    whole = F.concat(F.lit("<p>"), xml_out.escape(F.regexp_replace(F.coalesce("html", F.lit("")), CLEAN, "")), F.when(F.col("page_id") % 2 == 0, "</p>").otherwise(""))
    n = xml.nodes(_read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), whole.alias("text")))
    return n.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.col("error").isNotNull()).alias("broken"))


# X12


def interchanges(spark, d) -> DataFrame:
    """One interchange for each customer with orders: a transaction set for each order, a loop for each line."""
    # rows are dealt out before they are rendered and before they are collected: numbers are sent instead of texts, and a list isn't made
    # in parts that are sent, sorted and put together again
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_shipdate").repartition("l_orderkey")
    line = x12_out.segment("IT1", F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit(None), x12_out.composite([F.lit("PN"), F.col("l_partkey").cast("string")]), F.lit(None))
    day = x12_out.segment("DTM", F.lit("011"), F.date_format("l_shipdate", "yyyyMMdd"))
    # one text for the loop of each line: half the structs to sort
    body = li.select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("b"), F.concat(line, F.lit("~\n"), day).alias("t")).alias("s")).groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("s"))
    body = body.select("k", (F.size("s") * 2 + 3).alias("n"), F.array_join(F.col("s")["t"], "~\n").alias("lines"))
    head = x12_out.segment("BEG", F.lit("00"), F.col("o_orderstatus"), leaf.encode_x12_integer(F.col("o_orderkey"), 9), F.lit(None), leaf.encode_x12_date(F.col("o_orderdate"), 6))
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("doc_id"), head.alias("head"))
    control = leaf.encode_x12_integer(F.col("k"), 4)
    # a text for each order; never broadcast, as texts are larger than the columns that they come from
    tx = o.join(body.hint("merge"), "k").select("doc_id", "k", F.concat_ws("~\n", x12_out.segment("ST", F.lit("850"), control), "head", "lines", x12_out.segment("SE", F.col("n"), control)).alias("t"))
    per = tx.repartition("doc_id").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "t")))["t"], "~\n").alias("t"), F.count("*").alias("n"))
    isa = x12_out.interchange_header(F.lit("SENDER"), F.col("doc_id").cast("string"), F.lit("2026-01-01").cast("date"), F.lit("0000"), F.col("doc_id"))
    whole = F.concat_ws("~\n", isa, x12_out.segment("GS", F.lit("PO"), F.lit("S"), F.lit("R"), F.lit("20260101"), F.lit("0000"), F.lit("1"), F.lit("X"), F.lit("005010")), "t", x12_out.segment("GE", F.col("n"), F.lit("1")), x12_out.segment("IEA", F.lit("1"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    return per.select("doc_id", F.concat(whole, F.lit("~")).alias("text"))


def _segments(spark, d) -> DataFrame:
    return x12.segments(interchanges(spark, d), "doc_id")


_JOINED = "from orders join lineitem on l_orderkey = o_orderkey"


@query(f"select tag, count(*) as n from (select unnest(['IT1', 'DTM']) as tag {_JOINED} union all select unnest(['ST', 'BEG', 'SE']) from (select distinct o_orderkey {_JOINED}) union all select unnest(['ISA', 'GS', 'GE', 'IEA']) from (select distinct o_custkey {_JOINED})) group by 1")
def x12_segments_count(spark, d):
    return _segments(spark, d).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"select o_custkey as custkey, 1::bigint as isa, 1::bigint as gs, count(distinct o_orderkey) as sets, count(*) as lines {_JOINED} group by 1")
def x12_envelope_ids(spark, d):
    s = x12.envelopes(_segments(spark, d), "doc_id")
    return s.groupBy(F.col("doc_id").alias("custkey")).agg(F.max("isa").alias("isa"), F.max("gs").alias("gs"), F.max("st").alias("sets"), F.sum((F.col("tag") == "IT1").cast("long")).alias("lines"))


@query(f"select o_custkey as custkey, row_number() over (partition by o_custkey order by o_orderkey) as st, 3 + 2 * n as counted, 3 + 2 * n as stated, true as agrees from (select o_custkey, o_orderkey, count(*) as n {_JOINED} group by 1, 2)")
def x12_control_totals(spark, d):
    return x12.control_totals(_segments(spark, d), "doc_id").select(F.col("doc_id").alias("custkey"), "st", "counted", "stated", "agrees")


@query(f"select o_orderkey as orderkey, count(*) as n_lines, sum(l_quantity::int)::bigint as quantity, max(l_linenumber)::bigint as last_loop {_JOINED} group by 1")
def x12_loop_collect(spark, d):
    s = x12.envelopes(_segments(spark, d), "doc_id").where("st > 0")
    s = x12.loops(s, "IT1", "it1", ["doc_id", "st"])
    key = s.where("tag = 'BEG'").select("doc_id", "st", leaf.decode_x12_integer(x12.element(3)).alias("orderkey"))
    lines = s.where("tag = 'IT1'").groupBy("doc_id", "st").agg(F.count("*").alias("n_lines"), F.sum(x12.element(2).cast("int")).alias("quantity"), F.max(x12.element(1).cast("long")).alias("last_loop"))
    return lines.join(key, ["doc_id", "st"]).select("orderkey", "n_lines", "quantity", "last_loop")


@query(f"select l_partkey as partkey, 'PN' as qualifier, count(*) as n {_JOINED} group by 1")
def x12_composite_split(spark, d):
    s = _segments(spark, d).where("tag = 'IT1'").withColumn("c", x12.components(x12.element(4), F.col("component_sep")))
    return s.groupBy(F.get("c", F.lit(1)).cast("bigint").alias("partkey"), F.get("c", F.lit(0)).alias("qualifier")).agg(F.count("*").alias("n"))


@query(f"select d, count(*) as n from (select l_shipdate::date as d {_JOINED} union all select strptime('20' || strftime(o_orderdate, '%y%m%d'), '%Y%m%d')::date from orders where o_orderkey in (select l_orderkey from lineitem)) group by 1")
def x12_dates_multiformat(spark, d):
    s = _segments(spark, d)
    got = s.where("tag = 'DTM'").select(leaf.decode_x12_date(x12.element(2)).alias("d")).unionByName(s.where("tag = 'BEG'").select(leaf.decode_x12_date(x12.element(5)).alias("d")))
    return got.groupBy("d").agg(F.count("*").alias("n"))


@query("select o_orderkey as orderkey, lpad(o_orderkey::varchar, greatest(9, length(o_orderkey::varchar))::int, '0') as padded from orders where o_orderkey in (select l_orderkey from lineitem)")
def x12_zero_padded_int(spark, d):
    s = _segments(spark, d).where("tag = 'BEG'")
    return s.select(leaf.decode_x12_integer(x12.element(3)).alias("orderkey"), x12.element(3).alias("padded"))


@query("select p_partkey as partkey, case when p_size % 3 = 0 then 4 when p_size % 3 = 1 then 2 else 1 end as n_elements from part")
def x12_truncate_empty(spark, d):
    """Empty elements at the end are cut, those before another stay."""
    third = F.col("p_size") % 3
    text = x12_out.segment("N1", F.col("p_partkey"), F.when(third == 1, "x"), F.lit(None), F.when(third == 0, "y").otherwise(""), F.lit(None))
    s = x12.segments(_read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(text, F.lit("~")).alias("text")), "doc_id")
    return s.select(F.col("doc_id").alias("partkey"), F.size("elements").alias("n_elements"))


@query("select n_nationkey as hl_nation, r_regionkey::varchar as parent_region from nation join region on n_regionkey = r_regionkey")
def x12_hl_parent_join(spark, d):
    n = _read(spark, d, "nation").join(F.broadcast(_read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    child = n.groupBy("r_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("c"))
    body = F.concat(F.array(x12_out.segment("HL", F.lit("1"), F.lit(None), F.lit("20"), F.lit("1")), x12_out.segment("REF", F.col("r_regionkey"))), F.flatten(F.transform("c", lambda x: F.array(x12_out.segment("HL", x + 2, F.lit("1"), F.lit("21"), F.lit("0")), x12_out.segment("REF", x)))))
    docs = child.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.array_join(body, "~"), F.lit("~")).alias("text"))
    s = x12.segments(docs, "doc_id")
    h = x12.hierarchy(s, ["doc_id"]).where("parent_pos is not null")
    ref = s.where("tag = 'REF'").select("doc_id", (F.col("pos") - 1).alias("pos"), x12.element(1).alias("ref"))
    parent = ref.select("doc_id", F.col("pos").alias("parent_pos"), F.col("ref").alias("parent_region"))
    return h.join(ref, ["doc_id", "pos"]).join(parent, ["doc_id", "parent_pos"]).select(F.col("ref").cast("int").alias("hl_nation"), "parent_region")


@query(f"select o_custkey as custkey, 1 as n_interchanges, count(distinct o_orderkey)::int as n_sets {_JOINED} group by 1")
def x12_nested(spark, d):
    n = x12.nested(_segments(spark, d), "doc_id")
    sets = F.flatten(F.flatten(F.transform("interchanges", lambda i: F.transform(i["functional_groups"], lambda g: g["transaction_sets"]))))
    return n.select(F.col("doc_id").alias("custkey"), F.size("interchanges").alias("n_interchanges"), F.size(sets).alias("n_sets"))


@query(f"select o_custkey as custkey, count(*) * 2 + count(distinct o_orderkey) * 3 + 4 as n_segments, true as same {_JOINED} group by 1")
def x12_write_back(spark, d):
    docs = interchanges(spark, d)
    s = x12.segments(docs, "doc_id")
    back = x12_out.render(s, ["doc_id"], ["pos"])
    n = s.groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    same = F.regexp_replace(docs["text"], "\n", "") == back["text"]
    return docs.join(back, "doc_id").join(n, "doc_id").select(F.col("doc_id").alias("custkey"), "n_segments", same.alias("same"))


# guide tables, made from the base tables


def _guide(spark, d) -> dict[str, DataFrame]:
    """Parts as segments with elements: every part is a segment row, its brand the segment, its size the element."""
    p = _read(spark, d, "part")
    empty = {k: spark.createDataFrame([], guide.schema(k)) for k in guide.TABLES}
    seq = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    detail = p.select(F.lit("850").alias("set_transaction_id"), F.lit("1").alias("area"), seq.alias("sequence"), F.col("p_brand").alias("segment_id"), F.when(F.col("p_size") % 2 == 0, "M").otherwise("O").alias("requirement"), F.lit("1").alias("maximum_use"), F.lit("0").alias("loop_level"), F.lit("1").alias("loop_repeat"), F.lit(None).cast("string").alias("loop_identifier"))
    segs = p.select("p_brand").distinct().select(F.col("p_brand").alias("segment_id"), F.lit("01").alias("sequence"), F.concat(F.lit("E"), F.col("p_brand")).alias("data_element_number"), F.lit("M").alias("requirement"), F.lit("1").alias("repeat"))
    types = segs.select("data_element_number", F.when(F.crc32("data_element_number") % 2 == 0, "ID").otherwise("AN").alias("data_element_type"), F.lit("1").alias("minimum_length"), F.lit("8").alias("maximum_length"))
    heads = segs.select("data_element_number", F.concat(F.lit("Name, (of) "), "data_element_number").alias("data_element_name"))
    con_cols = {c: F.lit(None).cast("string") for c in guide.columns("CONDETL")}
    use = p.where("p_size > 10").select(*[(con_cols | {"record_type": F.lit("A"), "area": F.lit("1"), "sequence": seq, "usage": F.lit("1")})[c].alias(c) for c in con_cols])
    gone = p.where("p_size > 40").select(*[(con_cols | {"record_type": F.lit("C"), "area": F.lit("1"), "sequence": seq, "segment_id": F.col("p_brand"), "reference_designator": F.lit("01"), "usage": F.when(F.col("p_size") > 45, "8").otherwise("1")})[c].alias(c) for c in con_cols])
    ctx_cols = {c: F.lit(None).cast("string") for c in guide.columns("CONTEXT")}
    notes = p.where("p_size % 3 = 0").select(*[(ctx_cols | {"record_type": F.lit("C"), "area": F.lit("1"), "sequence": seq, "reference_designator": F.lit("01"), "note_type": F.lit("F"), "note": F.concat(F.lit("Part Note "), "p_size")})[c].alias(c) for c in ctx_cols])
    return empty | {"SETDETL": detail, "SEGDETL": segs, "ELEDETL": types, "ELEHEAD": heads, "CONDETL": use.unionByName(gone), "CONTEXT": notes}


@query("select p_brand as segment_id, count(*) as n, count(*) filter (where p_size % 2 = 1) as optional from part where p_size > 10 group by 1")
def guide_semi_usage(spark, d):
    return guide.kept_segments(_guide(spark, d)).groupBy("segment_id").agg(F.count("*").alias("n"), F.sum(F.col("optional").cast("long")).alias("optional"))


@query("select p_partkey as partkey, case when p_size % 3 = 0 then 'part-note-' || p_size else 'name-of-' || lower('E' || p_brand) end || '-01' as name, not (p_size between 41 and 45) as optional from part where p_size > 10 and p_size <= 45")
def guide_elements_named(spark, d):
    g = guide.guide_elements(_guide(spark, d))
    return g.select(F.col("sequence").cast("bigint").alias("partkey"), "name", "optional")


@query("select distinct p_brand as segment_id, 'name-of-' || lower('E' || p_brand) || '-01' as name, 1 as min, 8 as max from part")
def guide_lookup_left_join(spark, d):
    return guide.plain_elements(_guide(spark, d)).select("segment_id", "name", "min", "max")


# ordered rows, checks and registries


@query("select user_id, max(run)::bigint as runs, count(*) as n from (select user_id, sum(c) over (partition by user_id order by ts, event_id) as run from (select *, case when event_type is not distinct from lag(event_type) over w and row_number() over w > 1 then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id))) group by 1")
def gap_island_event_runs(spark, d):
    e = sequences.runs(_read(spark, d, "events"), F.col("event_type"), ["user_id"], ["ts", "event_id"])
    return e.groupBy("user_id").agg(F.max("run").alias("runs"), F.count("*").alias("n"))


_PREFIX = "select *, min(case when coalesce(value < 60, false) then 1 else 0 end) over (partition by user_id order by ts, event_id) as ok from events"


@query(f"select event_id, user_id from ({_PREFIX}) where ok = 1")
def take_while_prefix(spark, d):
    return sequences.take_while(_read(spark, d, "events"), F.col("value") < 60, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query(f"select event_id, user_id from ({_PREFIX}) where ok = 0")
def drop_while_suffix(spark, d):
    return sequences.drop_while(_read(spark, d, "events"), F.col("value") < 60, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query("select distinct user_id, min(case when ok = 0 and coalesce(value < 60, false) then event_id end) over (partition by user_id) as next_header from (select *, min(case when coalesce(value < 60, false) then 1 else 0 end) over (partition by user_id order by event_id) as ok from events)")
def next_sibling(spark, d):
    e = sequences.next_sibling(_read(spark, d, "events"), F.col("value") < 60, ["user_id"], ["event_id"], "event_id")
    return e.select("user_id", "next_header").distinct()


@query("select user_id, case when count(distinct event_type) <= 1 then min(event_type) end as event_type, count(distinct event_type) > 1 as ambiguous from events group by 1")
def check_at_most_one_distinct(spark, d):
    return sequences.at_most_one(_read(spark, d, "events"), ["user_id"], "event_type", strict=False)


@query("select user_id, arg_min(event_type, event_id) filter (where event_type <> 'view') as event_type from events group by 1")
def first_non_null_ordered(spark, d):
    e = _read(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    return sequences.first_known(e, ["user_id"], "event_type", F.col("event_id"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def registry_last_wins(spark, d):
    return sequences.last_wins(_read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("select n_name as base, n_nationkey::varchar as plain, case when n_nationkey % 2 = 0 then (n_nationkey + 100)::varchar end as seq from nation")
def registry_pivot_base_seq(spark, d):
    n = _read(spark, d, "nation")
    plain = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("form"))
    seq = n.where("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit("-seq")).alias("key"), (F.col("n_nationkey") + 100).cast("string").alias("form"))
    return graphs.pivot_sequences(plain.unionByName(seq))


@query("select 'ns/' || lower(n_name) || '.json' as path, 2 as n from nation where n_nationkey % 3 = 0")
def path_collisions(spark, d):
    n = _read(spark, d, "nation").withColumn("n_name", F.translate("n_name", " -.", "___"))
    keys = n.select(F.concat(F.lit("ns/"), "n_name").alias("key")).unionByName(n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("ns/"), F.concat(F.lower("n_name"))).alias("key")))
    return graphs.path_collisions(keys).select("path", F.size("keys").alias("n"))


ORACLE_SQL["path_collisions"] = "select 'ns/' || lower(translate(n_name, ' -.', '___')) || '.json' as path, 2 as n from nation where n_nationkey % 3 = 0 and n_name <> lower(n_name)"


@query("with recursive e(a, b) as (select p_partkey, (p_partkey * 7 + 3) % (select count(*) from part) from part where p_partkey % 3 <> 0), r(seed, key) as (select p_partkey, p_partkey from part union select seed, b from r join e on r.key = e.a) select seed, count(*) as n, max(key) as top from r group by 1")
def reachability_closure(spark, d):
    """Every part as a seed."""
    p = _read(spark, d, "part")
    n = p.count()
    edges = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 7 + 3) % n).alias("target"))
    return graphs.reach(edges, p.select(F.col("p_partkey").alias("seed")))


@query("select p_partkey as partkey, replace(lower(regexp_replace(p_name, '[/,()]', '', 'g')), ' ', '-') || '-' || p_size as name from part")
def slug_names(spark, d):
    return _read(spark, d, "part").select(F.col("p_partkey").alias("partkey"), names.numbered(names.slug(F.col("p_name")), F.col("p_size")).alias("name"))


_HOST = "array_to_string(list_filter(list_concat(list_reverse(string_split(split_part(split_part(regexp_extract(url, '://([^?#]*)', 1), '/', 1), ':', 1), '.')), string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')), lambda x: x <> ''), '.')"
_URN = "array_to_string(list_filter(list_reverse(string_split(url[5:], ':')), lambda x: x <> ''), '.')"


@query(f"select page_id, case when url like 'urn:%' then {_URN} when url like '%://%' then {_HOST} else url end as ns, page_id || '.b.a' as urn, 'plain' || page_id as plain from pages")
def uri_namespace(spark, d):
    urn = F.concat(F.lit("urn:a:b:"), F.col("page_id"))
    return _read(spark, d, "pages").select("page_id", names.uri_namespace(F.col("url")).alias("ns"), names.uri_namespace(urn).alias("urn"), names.uri_namespace(F.concat(F.lit("plain"), F.col("page_id"))).alias("plain"))


XSD_STATUS = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="wide"><xs:restriction base="xs:string"><xs:enumeration value="F"/><xs:enumeration value="O"/><xs:enumeration value="X"/></xs:restriction></xs:simpleType>
<xs:simpleType name="narrow"><xs:restriction base="wide"><xs:enumeration value="F"/><xs:enumeration value="O"/><xs:enumeration value="P"/></xs:restriction></xs:simpleType></xs:schema>"""


@query("select o_orderkey as orderkey, o_orderstatus in ('F', 'O') as allowed from orders")
def enum_intersection(spark, d):
    """A type that narrows another has the values of both enumerations."""
    facets = xsd.loads(XSD_STATUS, "s").types["s/narrow"]["facets"]
    bad = validate.facet_checks(F.col("o_orderstatus"), facets, "status")[0]
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), bad.isNull().alias("allowed"))


@query("select * from (values ('c/customer', '_name', 'name', 1, 'string'), ('c/customer', '_enum', 'segment', 1, 'string'), ('c/customer', '_pattern', 'code', 1, 'string'), ('c/customer', '_attr', 'id', 1, 'long')) v(key, what, name, min, base)")
def xsd_tables(spark, d):
    t = xsd.loads(XSD_CUSTOMER, "c").to_dataframes(spark)["xsd_fields"]
    what = F.when(F.col("attr"), "_attr").when(F.col("name") == "segment", "_enum").when(F.col("name") == "code", "_pattern").otherwise("_name")
    return t.select("key", what.alias("what"), "name", "min", "base")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders to XML, back through the schema, and summed."""
    return xml_repeat_order_lines(spark, d)


from . import typed_queries  # noqa: E402, F401  (adds its queries to the tables above)

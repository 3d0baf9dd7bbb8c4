"""Node tables, X12 segments, guide tables, ordered operators and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import leaf
from arborlake.operators import graphs, sequences
from arborlake.plans import guide, transactions, validate
from arborlake.sinks import x12 as x12_out
from arborlake.sinks import xml as xml_out
from arborlake.sources import x12, xml
from arborlake.streaming.documents import write_stream, xml_stream


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")


def test_order_text_and_attributes(spark):
    n = xml.nodes(docs(spark, '<r u="1">a <b>x</b> c<!-- n --> d<b/><a>2</a></r>', None, "<r>", ""))
    items = xml.ordered_content(n, n.where("doc_id = 0 and depth = 0 and kind = 'elem'")).first()["items"]
    assert [(i.tag, i.value) for i in items] == [(None, "a "), ("b", "x"), (None, " c d"), ("b", None), ("a", "2")]
    assert [r.value for r in n.where("kind = 'attr'").collect()] == ["1"]
    assert n.where("error is not null").select("doc_id").distinct().count() == 2
    assert n.where("doc_id = 1").count() == 0


def test_external_entities_are_not_loaded(spark):
    n = xml.nodes(docs(spark, '<!DOCTYPE r [<!ENTITY e SYSTEM "file:///etc/hostname">]><r>a&e;b</r>'))
    assert [r.value for r in n.where("kind = 'text'").collect()] in (["ab"], ["a", "b"])


def test_write_is_a_fixpoint(spark):
    text = '<r xmlns="http://ex.org/a" k="1 &lt; 2"><b>x &amp; y</b>tail<c xmlns="http://ex.org/b"/></r>'
    first = xml.nodes(docs(spark, text))
    back = xml_out.from_nodes(first)
    second = xml.nodes(back)
    cols = ["node_id", "parent_id", "last_desc", "kind", "ns", "tag", "value"]
    assert first.orderBy("node_id").select(cols).collect() == second.orderBy("node_id").select(cols).collect()


def test_order_and_closed_world_checks(spark):
    n = xml.nodes(docs(spark, "<r><b/><a/><z/></r>", "<r><a/><b/></r>"))
    assert [(r.doc_id, r.tag) for r in validate.out_of_order(n, "r", ["a", "b"]).where("tag = 'a'").collect()] == [(0, "a")]
    allowed = spark.createDataFrame([("r", "a"), ("r", "b")], "parent string, tag string")
    assert [(r.doc_id, r.tag) for r in validate.unexpected_children(n, allowed).collect()] == [(0, "z")]


ISA = "ISA*00*          *00*          *ZZ*ReceiverID     *ZZ*Sender         *050812*1953*^*00501*508121953*0*P*:~\n"
BINARY = ISA + "GS*FA*A*B*20190922*155401*1*X*005010~\nST*000*0001~\nBIN*25*12345678901234567890\n1234~\nBIN*12*12345~7890*1~\nSE*4*0001~\nGE*1*1~\nIEA*1*508121953~\n"
NEWLINES = ISA.replace("~\n", "\n").replace("^*00501", "U*00400") + "GS*HS*1*2*20120117*1719*1*X*004010\nST*270*1234\n  EQ*30**FAM:X\nSE*3*1234\nGE*1*1\nIEA*1*508121953\n"


def test_delimiters_and_binary(spark):
    s = x12.segments(docs(spark, BINARY, NEWLINES, "ST*1*2~N1*a*~SE*3*2~", None, ""), "doc_id")
    got = {k: [r.tag for r in s.where(F.col("doc_id") == k).orderBy("pos").collect()] for k in range(5)}
    assert got[0] == ["ISA", "GS", "ST", "BIN", "BIN", "SE", "GE", "IEA"]
    assert got[1] == ["ISA", "GS", "ST", "EQ", "SE", "GE", "IEA"]
    assert got[2] == ["ST", "N1", "SE"] and not got[3] and not got[4]
    assert s.where("doc_id = 0 and pos = 5").first().elements == ["12", "12345~7890*1"]
    assert s.where("doc_id = 1").first().repeat_sep is None
    eq = s.where("tag = 'EQ'").select(x12.element(2).alias("e"), x12.components(x12.element(3), F.col("component_sep")).alias("c")).first()
    assert eq.e is None and eq.c == ["FAM", "X"]
    totals = {r.doc_id: r.agrees for r in x12.control_totals(s, "doc_id").collect()}
    assert totals == {0: True, 1: True, 2: True}


def test_x12_writer(spark):
    df = spark.createDataFrame([(1, 2, "N1", ["a", None, ""]), (1, 1, "ST", ["850", "1"])], "doc int, pos int, tag string, elements array<string>")
    assert x12_out.render(df, ["doc"], ["pos"]).first().text == "ST*850*1~N1*a~"
    assert spark.range(1).select(x12_out.composite([F.lit("A"), F.lit(None), F.lit("B"), F.lit(None)])).first()[0] == "A::B"


def test_loops_and_hierarchy(spark):
    s = x12.segments(docs(spark, "ST*1*1~HL*1**20~NM1*2B~HL*2*1*21~NM1*1P~HL*3*2*22~SE*7*1~"), "doc_id")
    assert [r.n for r in x12.loops(s, "HL", "n", ["doc_id"]).orderBy("pos").collect()] == [0, 1, 1, 2, 2, 3, 3]
    h = {r.hl_id: r.parent_pos for r in x12.hierarchy(s, ["doc_id"]).collect()}
    assert h == {"1": None, "2": 2, "3": 4}


@pytest.fixture(scope="module")
def guide_folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("guide")
    files = {
        "setdetl": ["850,1,010,ST,M,1,0,1,", "850,1,020,BEG,M,1,0,1,", "850,2,010,HL,O,1,1,>1,HL", "850,2,020,NM1,O,3,1,1,", "850,2,030,LX,O,1,2,1,LX", "850,2,040,REF,O,>1,2,1,", "850,3,010,SE,M,1,0,1,", "850,3,020,ZZ,O,1,0,1,"],
        "seghead": ["ST,Set Header", "ISA,Interchange Header", "GS,Group Header", "GE,Group Trailer", "IEA,Interchange Trailer"],
        "segdetl": ["ST,01,143,M,1", "ST,02,329,M,1", "BEG,01,353,M,1", "BEG,02,373,M,1", "HL,01,628,M,1", "NM1,01,C001,O,1", "REF,01,128,M,1", "LX,01,554,M,1", "SE,01,96,M,1", "ISA,01,I01,M,1", "GS,01,479,M,1"],
        "comhead": ["C001,Unit / Measure"],
        "comdetl": ["C001,02,1018,O", "C001,01,355,M"],
        "elehead": ["143,Set ID Code", "329,Control Number", "353,Purpose Code", "373,Date", "628,HL ID", "355,Unit Code", "1018,Exponent", "128,Qualifier", "554,Number", "96,Count", "I01,Authorization", "479,Functional ID"],
        "eledetl": ["143,ID,3,3", "329,AN,4,9", "353,ID,2,2", "373,DT,6,8", "628,AN,1,12", "355,ID,2,2", "1018,R,1,15", "128,ID,2,3", "554,N0,1,6", "96,N0,1,10", "I01,ID,2,2", "479,ID,2,2"],
        "condetl": [f"A,850,{a},{s},,,,,,,,,1" for a, s in (("1", "010"), ("1", "020"), ("2", "010"), ("2", "020"), ("2", "030"), ("2", "040"), ("3", "010"))] + ["C,850,1,020,BEG,01,,,353,,,,1", "C,850,1,010,ST,02,,,329,,,,8", "E,850,1,020,BEG,01,,,353,00,,,", "E,850,1,020,BEG,01,,,353,05,,,", "D,850,2,020,NM1,01,C001,01,355,,,,1"],
        "context": ["B,850,1,020,BEG,,,,,,,,1,A,Beginning Segment", "C,850,1,020,BEG,02,,,373,,,,1,F,Order Date"],
    }
    for k, rows in files.items():
        (d / f"{k}.txt").write_text("\n".join(rows) + "\n")
    return str(d)


def test_guide_tables(spark, guide_folder):
    spec = guide.load(spark, guide_folder)
    assert spec["SETHEAD"].count() == 0
    kept = {r.segment_id: r for r in guide.kept_segments(spec).collect()}
    assert "ZZ" not in kept and kept["BEG"].segment_name == "beginning-segment" and kept["REF"].repeated
    e = {(r.segment_id, r.element_sequence, r.component_sequence): r for r in guide.guide_elements(spec).collect()}
    assert ("ST", "02", None) not in e
    assert e["BEG", "01", None].codes == ["00", "05"] and not e["BEG", "01", None].optional
    assert e["BEG", "02", None].name == "order-date-02" and e["BEG", "02", None].formats == ["yyyyMMdd", "yyMMdd"]
    assert e["NM1", "01", "01"].composite == "unit--measure-01" and not e["NM1", "01", "01"].optional
    tree = {r.segment_id: (r.loop_id, r.parent_loop_id) for r in guide.loop_tree(spec).collect()}
    assert tree["NM1"] == ("HL", None) and tree["LX"] == ("LX", "HL") and tree["SE"] == (None, None)
    m = guide.message_struct(spec)
    assert m.names == ["ST", "beginning-segment", "HL", "SE"]
    assert isinstance(m["HL"].dataType, T.ArrayType) and m["HL"].dataType.elementType.names == ["HL", "NM1", "LX"]
    assert guide.interchange_struct(spec, m).names[1] == "functional-groups"


def test_sequences_and_checks(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "g int, k int, v string")
    assert [r.run for r in sequences.runs(df, F.col("v"), ["g"], ["k"]).orderBy("k").collect()] == [1, 1, 2, 2, 3]
    assert sequences.take_while(df, F.col("v") == "a", ["g"], ["k"]).count() == 2
    assert sequences.drop_while(df, F.col("v") == "a", ["g"], ["k"]).count() == 3
    assert sequences.next_sibling(df, F.col("v") == "a", ["g"], ["k"], "k").first().next_header == 5
    assert sequences.first_known(df, ["g"], "v", F.col("k")).first().v == "a"
    assert sequences.last_wins(df, ["g"], F.col("k")).first().k == 5
    with pytest.raises(Exception, match="too many"):
        sequences.at_most_one(df, ["g"], "k").collect()


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("d",), ("x",)], "seed string")
    got = {(r.seed, r.key) for r in graphs.reachable(edges, seeds).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("x", "x")}
    reg = spark.createDataFrame([("n/A", "1"), ("n/a", "2"), ("n/A-seq", "3"), ("n/Z-seq", "4")], "key string, form string")
    assert graphs.path_collisions(reg).count() == 1
    assert {(r.base, r.plain, r.seq) for r in graphs.pivot_sequences(reg).collect()} == {("n/A", "1", "3"), ("n/a", "2", None), ("n/Z-seq", "4", None)}
    assert graphs.missing_seeds(seeds, reg).count() == 3
    assert graphs.name_collisions(reg.select(F.col("key").alias("name"))).first().name == "n/A"


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.xml").write_text(f"<r><k>{k}</k></r>")
    df = xml_stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("k", T.LongType())])).select("value.k")
    write_stream(df, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_leaf_types_can_be_added():
    leaf.register("my:upper", T.StringType(), F.upper, F.lower)
    assert leaf.leaf("my:upper").name == "my:upper"
    assert leaf.leaf("unknown").data_type == T.StringType()


def test_table_functions(spark):
    from arborlake.functions import tables

    tables.register(spark)
    docs(spark, "<r><a/>x</r>", None).createOrReplaceTempView("some_docs")
    assert [r.kind for r in spark.sql("select doc_id, n.* from some_docs, lateral xml_nodes(text) n order by node_id").collect()] == ["elem", "elem", "text"]
    assert [r.tag for r in spark.sql("select * from x12_segments('ST*1*1~N1*a~SE*3*1~') order by pos").collect()] == ["ST", "N1", "SE"]


def test_binary_segments_in_one_pass(spark):
    texts = [BINARY, "ST*1*1~BIN*5*a~b*c~N1*x~BIN*99*cut~SE*3*1~", "BIN*x*y~ST*1~"]
    got = {k: [(r.tag, r.elements) for r in x12.segments(docs(spark, *texts), "doc_id").where(F.col("doc_id") == k).orderBy("pos").collect()] for k in range(3)}
    assert [t for t, _ in got[0]] == ["ISA", "GS", "ST", "BIN", "BIN", "SE", "GE", "IEA"]
    assert got[1][1] == ("BIN", ["5", "a~b*c"]) and got[1][2] == ("N1", ["x"]) and got[1][3][1][0] == "99"
    assert got[2][0] == ("BIN", ["x", "y"]) and got[2][1][0] == "ST"


def test_typed_transactions(spark, guide_folder):
    spec = guide.load(spark, guide_folder)
    kind = guide.message_struct(spec)
    text = "ST*850~BEG*05*20240229~HL*1~NM1*AB:2.50*extra~LX*007~REF*12~REF*345~LX*8~HL*2~ZZZ*1*2~SE*9~"
    v = transactions.read(docs(spark, text, None, "", "BEG*99*20240101~"), kind)
    got = {r.doc_id: r for r in v.collect()}
    one = got[0].value
    assert one["beginning-segment"]["order-date-02"].isoformat() == "2024-02-29" and one["beginning-segment"]["purpose-code-01"] == "05"
    assert one["HL"][0]["NM1"][0]["unit--measure-01"]["unit-code-01"] == "AB" and str(one["HL"][0]["NM1"][0]["unit--measure-01"]["exponent-02"]).startswith("2.5")
    loops = one["HL"][0]["LX"] if isinstance(one["HL"][0]["LX"], list) else [one["HL"][0]["LX"]]
    assert loops[0]["LX"]["number-01"] == 7 and [r["qualifier-01"] for r in loops[0]["REF"]] == ["12", "345"] and len(one["HL"]) == 2
    assert {(u.tag, tuple(u.elements)) for u in got[0].unread} >= {("NM1", ("extra",)), ("ZZZ", ("1", "2"))}
    assert got[1].value is None and got[2].value is None and got[3].unread[0].tag == "BEG"
    back = v.where("doc_id = 0").select(transactions.write(F.col("value"), kind).alias("text"))
    again = transactions.read(back.withColumn("doc_id", F.lit(0)), kind).first()
    assert again.value == one


def test_totals_and_leftovers(spark):
    s = x12.segments(docs(spark, BINARY, BINARY.replace("GE*1*1", "GE*2*1")), "doc_id")
    got = {(r.doc_id, r.level): r.agrees for r in x12.envelope_totals(s, "doc_id").collect()}
    assert got == {(0, "GE"): True, (0, "IEA"): True, (1, "GE"): False, (1, "IEA"): True}
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "e array<string>")
    assert [r[0] for r in df.select(x12.leftover(F.col("e"), 1)).collect()] == [["b", "c"], None]


def test_long_chains_take_few_rounds(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(100, 50)], "source int, target int")
    seeds = spark.createDataFrame([(0,), (70,), (None,)], "seed int")
    got = graphs.reachable(edges, seeds.where("seed is not null")).groupBy("seed").count().collect()
    assert {r.seed: r["count"] for r in got} == {0: 101, 70: 51}

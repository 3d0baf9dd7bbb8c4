"""Results and plans that must hold on tables of any size."""

from pyspark.sql import functions as F

from arborlake.functions import leaf
from arborlake.operators import sequences
from arborlake.plans import guide, queries, typed_queries, validate
from arborlake.sources import x12, xml
from arborlake.sources.x12 import _cut_binary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unknown_children_broadcast_no_nodes(spark):
    docs = spark.createDataFrame([(1, "<order><line><part/><odd/></line></order>"), (2, "<order><line/></order>")], "doc_id int, text string")
    allowed = spark.createDataFrame([("order", "line"), ("line", "part")], "parent string, tag string")
    for n, joins in ((xml.nodes(docs), 1), (xml.nodes(docs, fields=["kind", "tag", "parent_tag"], kinds=("elem",)), 0)):
        got = validate.unexpected_children(n, allowed)
        assert plan(got).count("BroadcastHashJoin") <= 1 and plan(got).count("SortMergeJoin") == joins
        assert [(r.doc_id, r.parent, r.tag) for r in got.collect()] == [(1, "line", "odd")]


def test_long_documents_leave_in_pieces():
    text = '<r a="1">' + '<c id="7">x<d/></c>' * 40000 + "<deep>" * 50 + "y" + "</deep>" * 50 + " </r>"
    pieces = list(xml.Shredder().pieces(text))
    assert max(map(len, pieces)) < 20000
    rows = sorted((r for p in pieces for r in p), key=lambda r: r[0])
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 2 + 4 * 40000 + 51
    assert rows[0][:6] == [1, None, len(rows), 0, 1, "elem"] and rows[2][:6] == [3, 1, 6, 1, 1, "elem"]
    assert [[r[10] for r in p] for p in xml.Shredder().pieces(text[:-1])] == [[xml.Shredder().read(text[:-1])[0][10]]]


def test_nodes_limited_to_what_is_used(spark):
    docs = spark.createDataFrame([(1, '<r u="1">a<b v="2">x</b><c/></r>'), (2, "<r>"), (3, None)], "doc_id int, text string")
    every = xml.nodes(docs)
    some = xml.nodes(docs, fields=["kind", "tag", "node_id", "last_desc", "ord", "parent_tag"], kinds=("elem", "attr"))
    want = every.where("kind in ('elem', 'attr')").select("doc_id", "node_id", "last_desc", "ord", "kind", "tag")
    assert sorted(some.drop("parent_tag").collect()) == sorted(want.collect())
    assert {(r.tag, r.parent_tag) for r in some.collect()} == {("r", None), ("u", "r"), ("b", "r"), ("v", "b"), ("c", "r")}


def test_occurrence_bounds_take_one_pass(spark):
    docs = spark.createDataFrame([(1, "<r><a/><a/><a/></r>"), (2, "<r><a/></r>"), (3, "<r/>"), (4, "<a><a/><q><a/></q></a>")], "doc_id int, text string")
    got = validate.occurrence_bounds(xml.nodes(docs), "r", "a", 1, 2)
    assert "Join" not in plan(got)
    assert {(r.doc_id, r.node_id, r.n) for r in got.collect()} == {(1, 1, 3), (3, 1, 0)}
    assert {(r.doc_id, r.node_id, r.n) for r in validate.occurrence_bounds(xml.nodes(docs), "a", "a", 1, None).collect() if r.doc_id == 4} == {(4, 2, 0), (4, 4, 0)}


def test_interchanges_read_lines_once(spark, sf):
    got = queries.interchanges(spark, sf)
    scans = [x for x in plan(got).splitlines() if "FileScan" in x]
    assert len(scans) == 2 and "BroadcastHashJoin" not in plan(got)


ISA = "ISA*00*          *00*          *ZZ*A              *ZZ*B              *260101*0000*^*00501*000000001*0*P*:~"


def test_segments_cut_alike_for_all_delimiters(spark):
    plain = ISA + " \r\n ST*1~\tN1*a\\b**x*~~ ~SE*2*1~"
    texts = [plain] + [plain.translate(str.maketrans({"*": a, "~": b})) for a, b in (("|", "\n"), (".", "]"), ("+", "$"), ("é", "𝄞"), ("?", "("))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    s = x12.segments(docs, "doc_id")
    got = {}
    for r in s.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.tag, tuple(r.elements)))
    assert len(got) == len(texts) and all(got[k][1:] == got[0][1:] for k in got)
    assert got[0][1:] == [(2, "ST", ("1",)), (3, "N1", ("a\\b", "", "x", "")), (4, "SE", ("2", "1"))]
    assert "transform" not in plan(s).lower()


def test_nesting_takes_one_pass(spark):
    docs = spark.createDataFrame([(1, ISA + "GS*A~ST*1~B*1~SE*2~GE*1~GS*B~GE*0~IEA*2~"), (2, "ST*1~X~SE*2~"), (3, "X*1~"), (4, ISA + "IEA*0~")], "doc_id int, text string")
    n = x12.nested(x12.segments(docs, "doc_id"), "doc_id")
    assert "Join" not in plan(n)
    got = {r.doc_id: r.interchanges for r in n.collect()}
    assert sorted(got) == [1, 2, 4]
    assert [s.tag for s in got[1][0].envelope] == ["ISA", "GS", "GE", "GS", "GE", "IEA"]
    assert [[t.st for t in g.transaction_sets] for g in got[1][0].functional_groups] == [[1]]
    assert got[2][0].envelope is None and [s.tag for s in got[2][0].functional_groups[0].transaction_sets[0].segments] == ["ST", "X", "SE"]
    assert got[4][0].functional_groups is None


def test_cut_of_plain_texts_is_as_piece_by_piece():
    for text in ("A*1~ B~~\n~C*BIN*2~ ", "A~ \r\n", "A*1", "~", "A*1~BI"):
        assert _cut_binary(text, "*", "~") == _cut_binary(text + "~BIN*1*x~", "*", "~")[: len(_cut_binary(text, "*", "~"))]
    assert _cut_binary("A*1\n\n B\n", "*", "\n") == [["A", "1"], ["B"]]


def test_places_of_a_guide_are_never_broadcast(spark, sf):
    got = guide.guide_elements(typed_queries._composite_guide(spark, sf))
    joins = [x for x in plan(got).splitlines() if "Join" in x]
    assert not [x for x in joins if "Broadcast" in x and "sequence" in x]
    assert sum("sequence" in x for x in joins) == 6


def test_at_most_one_takes_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    got = sequences.at_most_one(df, ["k"], "v", strict=False)
    assert plan(got).count("Exchange") == 1
    assert {(r.k, r.v, r.ambiguous) for r in got.collect()} == {(1, "a", False), (2, None, True), (3, None, False)}


def test_envelopes_take_one_window(spark):
    docs = spark.createDataFrame([(1, ISA + "GS*A~ST*1~B*1~SE*2~ST*2~SE*1~GE*1~GS*B~GE*0~IEA*2~" + ISA + "IEA*0~"), (2, "X*1~ST~")], "doc_id int, text string")
    e = x12.envelopes(x12.segments(docs, "doc_id"), "doc_id")
    assert plan(e).count("Window [") == 1
    got = [(r.tag, r.isa, r.gs, r.st) for r in e.orderBy("doc_id", "pos").collect()]
    assert got == [("ISA", 1, 0, 0), ("GS", 1, 1, 0), ("ST", 1, 1, 1), ("B", 1, 1, 1), ("SE", 1, 1, 1), ("ST", 1, 1, 2), ("SE", 1, 1, 2), ("GE", 1, 1, 2), ("GS", 1, 2, 2), ("GE", 1, 2, 2), ("IEA", 1, 2, 2), ("ISA", 2, 2, 2), ("IEA", 2, 2, 2), ("X", 0, 0, 0), ("ST", 0, 0, 1)]


def test_tags_are_found_without_a_cut(spark):
    texts = ["ST *1~A~*x~BIN*3*a*~~N1*~", ISA.replace("*", "é") + "BéC~", "ISA", ""]
    s = x12.segments(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id")
    got = {}
    for r in s.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.tag, r.elements))
    assert got[0] == [("ST", ["1"]), ("A", []), ("", ["x"]), ("BIN", ["3", "a*~"]), ("N1", [""])] and got[1][1] == ("B", ["C"])
    assert [t for t, _ in got[2]] == ["I", "S", "A"] and 3 not in got
    assert "substring_index" in plan(s.select("tag"))


def test_lines_are_dealt_out_as_numbers_and_stay_with_their_days(spark, tmp_path):
    from datetime import datetime as day

    spark.createDataFrame([(7, 3, "O", day(1996, 1, 2)), (8, 3, "F", day(1997, 1, 2)), (9, 4, "F", day(1997, 1, 2))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(8, 5, 1, 2.0, day(1996, 2, 1)), (7, 11, 2, 3.0, day(1996, 3, 2)), (7, 12, 1, 4.0, day(1996, 3, 3)), (7, 10, 2, 1.0, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.interchanges(spark, str(tmp_path))
    # before rows of an order or a customer are together, nothing is collected
    assert plan(got).count("REPARTITION_BY_COL") == 2 and "ENSURE_REQUIREMENTS" not in "".join(x for x in plan(got).splitlines() if "l_orderkey" in x or "doc_id" in x)
    (doc,) = got.collect()
    assert doc.doc_id == 3 and doc.text.replace("\n", "").split("~")[2:-3] == [
        "ST*850*0007", "BEG*00*O*000000007**960102", "IT1*1*4**PN:12", "DTM*011*19960303", "IT1*2*1**PN:10", "DTM*011", "IT1*2*3**PN:11", "DTM*011*19960302", "SE*9*0007",
        "ST*850*0008", "BEG*00*F*000000008**970102", "IT1*1*2**PN:5", "DTM*011*19960201", "SE*5*0008",
    ]


def test_integers_are_padded_as_by_a_format(spark):
    df = spark.createDataFrame([(0,), (5,), (-5,), (12345678901,), (None,)], "n long")
    for least in (1, 4, 9):
        got = df.select(leaf.encode_x12_integer(F.col("n"), least).alias("a"), F.format_string(f"%0{least}d", "n").alias("b"))
        assert all(r.a == r.b for r in got.collect())

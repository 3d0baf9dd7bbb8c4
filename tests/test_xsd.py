"""The XSD compiler on small schemas of our own."""

import json

import pytest
from pyspark.sql import functions as F

from arborlake.plans import typed, validate, xsd
from arborlake.sources import xml

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns="http://ex.org/a" targetNamespace="http://ex.org/a" elementFormDefault="qualified">'
REPORT = (
    HEAD
    + """
<xs:simpleType name="code"><xs:restriction base="xs:string"><xs:pattern value="[A-Z]+"/><xs:maxLength value="4"/></xs:restriction></xs:simpleType>
<xs:simpleType name="short"><xs:restriction base="code"><xs:pattern value="A.*"/><xs:enumeration value="AB"/><xs:enumeration value="AC"/></xs:restriction></xs:simpleType>
<xs:attributeGroup name="common"><xs:attribute name="id" type="xs:int" use="required"/><xs:attribute name="lang"/></xs:attributeGroup>
<xs:complexType name="base"><xs:sequence><xs:element name="a" type="xs:decimal"/></xs:sequence><xs:attributeGroup ref="common"/></xs:complexType>
<xs:complexType name="more"><xs:complexContent><xs:extension base="base"><xs:sequence><xs:element name="b" type="short" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="currency" use="required"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:complexType name="tree"><xs:sequence><xs:element name="label" type="xs:string"/><xs:element name="child" type="tree" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>
<xs:complexType name="mixed" mixed="true"><xs:sequence><xs:element name="x" type="xs:string"/></xs:sequence></xs:complexType>
<xs:group name="pick"><xs:choice><xs:element name="p" type="xs:int"/><xs:element name="q" type="xs:string"/></xs:choice></xs:group>
<xs:complexType name="items"><xs:choice maxOccurs="unbounded"><xs:element name="p" type="xs:int"/><xs:element name="q" type="xs:string"/></xs:choice></xs:complexType>
<xs:simpleType name="ints"><xs:list itemType="xs:int"/></xs:simpleType>
<xs:simpleType name="either"><xs:union memberTypes="xs:int code"/></xs:simpleType>
<xs:element name="more" type="more"/><xs:element name="money" type="money"/><xs:element name="tree" type="tree"/>
</xs:schema>"""
)


@pytest.fixture(scope="module")
def graph():
    return xsd.loads(REPORT)


def test_struct_types(graph):
    k = "org.ex.a/"
    assert graph.to_struct(k + "more").simpleString() == "struct<_id:string,_lang:string,a:decimal(38,18),b:array<string>>"
    assert graph.to_struct(k + "more", typed_attributes=True)["_id"].dataType.simpleString() == "bigint"
    assert graph.to_struct(k + "money").simpleString() == "struct<_currency:string,_VALUE:decimal(38,18)>"
    assert graph.to_struct(k + "tree", depth=1).simpleString() == "struct<label:string,child:array<struct<label:string>>>"
    assert graph.to_struct(k + "items").simpleString() == "array<struct<ord:int,tag:string,value:string>>"
    assert graph.to_struct(k + "ints").simpleString() == "array<bigint>"
    assert graph.types[k + "mixed"]["kind"] == "any"
    assert graph.types[k + "pick"]["kind"] == "choice"


def test_facets_narrow(graph):
    f = graph.types["org.ex.a/short"]["facets"]
    assert f["enum"] == ["AB", "AC"] and f["max"] == 4 and f["pattern"] == ["[A-Z]+", "A.*"]


def test_reachability_and_cycles(graph, spark):
    k = "org.ex.a/"
    assert graph.is_cyclic(k + "tree") and not graph.is_cyclic(k + "more")
    assert set(graph.trim([k + "more"]).types) == {k + "more", k + "short"}
    with pytest.raises(xsd.SchemaError):
        graph.reachable(["nope"])
    tables = graph.to_dataframes(spark)
    assert tables["xsd_refs"].where("source = 'org.ex.a/tree' and target = 'org.ex.a/tree'").count() == 1


def test_emission_is_deterministic(graph, tmp_path):
    a, b = graph.emit(str(tmp_path / "a")), xsd.loads(REPORT).emit(str(tmp_path / "b"))
    assert a == b
    assert all((tmp_path / "a" / p).read_bytes() == (tmp_path / "b" / p).read_bytes() for p in [*a, "manifest.json"])
    again = xsd.SchemaGraph.from_json(graph.to_json())
    assert again.to_json() == graph.to_json()
    assert json.loads((tmp_path / "a" / a[0]).read_text())["key"]


def arms(*nodes):
    return {"kind": "choice", "arms": list(nodes)}


def named(tag):
    return {"name": tag, "node": {"kind": "leaf", "base": "int"}}


@pytest.mark.parametrize(
    "node,reason",
    [
        ({"kind": "empty"}, "no-choice"),
        (arms({"node": {"kind": "list", "item": {"kind": "leaf", "base": "int"}}}), "no-leading-tag"),
        (arms(named("x"), {"node": {"kind": "cat", "parts": []}}), "nothing-to-lead"),
        (arms(named("x"), named("y"), {"node": {"kind": "cat", "parts": [named("x"), named("z")]}}), "tag-twice"),
        (arms({"node": {"kind": "cat", "parts": [{"node": arms(named("x"), named("y"))}, named("z")]}}), "several-tags"),
    ],
)
def test_choices_that_cannot_be_unions(node, reason):
    with pytest.raises(xsd.SchemaError) as e:
        xsd.choice_to_union(node)
    assert e.value.reason == reason


def test_a_split_arm_keeps_its_member_and_its_tail():
    node = arms({"node": {"kind": "cat", "parts": [{"node": arms(named("x"), named("y"))}, named("z")]}}, named("w"))
    got = xsd.choice_to_union(node, split=True)["branches"]
    assert [p["name"] for p in got["x"]["parts"]] == ["x", "z"] and [p["name"] for p in got["y"]["parts"]] == ["y", "z"] and got["w"]["base"] == "int"


def test_dispatch_by_tag(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "tag string, k int")
    c = xsd.dispatch(F.col("tag"), {"a": F.col("k") * 10, "b": -F.col("k")}, F.lit(0))
    assert [r[0] for r in df.select(c).collect()] == [10, -2, 0, 0]


def test_numeric_facets(spark):
    g = xsd.loads('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="n"><xs:restriction base="xs:decimal"><xs:minInclusive value="9"/><xs:maxExclusive value="10.5"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>'
                  '<xs:simpleType name="m"><xs:restriction base="n"><xs:minInclusive value="10"/></xs:restriction></xs:simpleType><xs:element name="e"><xs:complexType><xs:sequence><xs:element name="v" type="m"/></xs:sequence></xs:complexType></xs:element></xs:schema>', "k")
    assert g.types["k/m"]["facets"]["minInclusive"] == "10"
    docs = spark.createDataFrame([(k, f"<e><v>{v}</v></e>") for k, v in enumerate(["10.25", "9.5", "10.5", "10.123"])], "id int, text string")
    got = xml.parse(docs, g.to_struct("k/e")).select(validate.violations(g, F.col("value"), "k/e").alias("v")).collect()
    assert [r.v for r in got] == [[], ["e/v: too small"], ["e/v: too large"], ["e/v: too many digits after the point"]]


def test_choices_and_order_are_validated(spark):
    g = xsd.loads('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="s"><xs:restriction base="xs:string"><xs:maxLength value="2"/></xs:restriction></xs:simpleType><xs:element name="e"><xs:complexType><xs:sequence>'
                  '<xs:choice><xs:element name="p" type="s"/><xs:element name="q" type="xs:int"/></xs:choice><xs:element name="r"><xs:complexType><xs:sequence maxOccurs="2"><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>', "k")
    texts = ["<e><p>ok</p><r><a>1</a><b>2</b></r></e>", "<e><p>long</p><r><a>1</a></r></e>", "<e><r><a>1</a><b>2</b></r></e>"]
    got = typed.read(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), g, "k/e").select("id", validate.violations(g, F.col("value"), "k/e").alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [[], ["e/p: too long", "e/r: order of its elements"], ["e: no choice"]]


def test_choice_to_union(graph):
    u = xsd.choice_to_union(graph.types["org.ex.a/pick"])
    assert sorted(u["branches"]) == ["p", "q"]
    with pytest.raises(xsd.SchemaError):
        xsd.unions_in(graph, ["nope"])
    assert xsd.unions_in(graph, ["nope"], missing="skip").types == graph.types
    with pytest.raises(xsd.SchemaError):
        xsd.check_sequence_names({"Foo", "Foo-seq"})


def test_parse_and_validate(graph, spark):
    docs = spark.createDataFrame([(1, '<more id="1"><a>2.5</a><b>AB</b></more>'), (2, "<more><b>ZZ</b></more>"), (3, None)], "doc_id int, text string")
    got = xml.parse(docs, graph.to_struct("org.ex.a/more"))
    v = {r.doc_id: r.v for r in got.select("doc_id", validate.violations(graph, F.col("value"), "org.ex.a/more").alias("v")).collect()}
    assert v[1] == [] and v[3] == []
    assert "more/a: required" in v[2] and "more/_id: required" in v[2] and "more/b: item" in v[2]
    assert xml.parse(docs, graph.to_struct("org.ex.a/more"), fields=["a"]).schema["value"].dataType.simpleString() == "struct<a:decimal(38,18)>"

"""Typed reading and writing by a schema graph."""

import datetime

import pytest
from pyspark.sql import functions as F

from arborlake.plans import typed, xsd
from arborlake.sinks import xml as xml_out

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns="http://ex.org/z" targetNamespace="http://ex.org/z" elementFormDefault="qualified">
<xs:complexType name="person"><xs:sequence><xs:element name="name" type="xs:string"/></xs:sequence><xs:attribute name="id" type="xs:int"/></xs:complexType>
<xs:complexType name="worker"><xs:complexContent><xs:extension base="person"><xs:sequence><xs:element name="wage" type="xs:decimal"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="tree"><xs:sequence><xs:element name="label" type="xs:string"/><xs:element name="child" type="tree" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>
<xs:group name="pair"><xs:sequence><xs:element name="x" type="xs:int"/><xs:element name="y" type="xs:int"/></xs:sequence></xs:group>
<xs:element name="all"><xs:complexType><xs:sequence>
<xs:element name="at" type="xs:dateTime" minOccurs="0"/><xs:element name="month" type="xs:gYearMonth" minOccurs="0"/><xs:element name="marks" type="xs:NMTOKENS" minOccurs="0"/>
<xs:element name="raw" type="xs:hexBinary" minOccurs="0"/><xs:element name="b64" type="xs:base64Binary" minOccurs="0"/><xs:element name="either" minOccurs="0"><xs:simpleType><xs:union memberTypes="xs:int xs:string"/></xs:simpleType></xs:element>
<xs:element name="who" type="person" minOccurs="0" maxOccurs="unbounded"/><xs:element name="tree" type="tree" minOccurs="0"/><xs:element name="open" minOccurs="0"/><xs:element name="nothing" minOccurs="0"><xs:complexType/></xs:element>
<xs:element name="pick" minOccurs="0"><xs:complexType><xs:choice><xs:element name="p" type="xs:int"/><xs:element name="q" type="xs:string"/></xs:choice><xs:attribute name="k"/></xs:complexType></xs:element>
<xs:element name="many" minOccurs="0"><xs:complexType><xs:choice maxOccurs="unbounded"><xs:element name="p" type="xs:int"/><xs:element name="q" type="person"/></xs:choice></xs:complexType></xs:element>
<xs:element name="pairs" minOccurs="0"><xs:complexType><xs:sequence maxOccurs="unbounded"><xs:group ref="pair"/><xs:element name="z" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType></xs:element>
<xs:element name="money" minOccurs="0"><xs:complexType><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="cur"/></xs:extension></xs:simpleContent></xs:complexType></xs:element>
<xs:choice minOccurs="0"><xs:element name="left" type="xs:int"/><xs:element name="right" type="xs:int"/></xs:choice>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""
KEY = "org.ex.z/all"


@pytest.fixture(scope="module")
def graph():
    return xsd.loads(XSD)


def one(spark, graph, inner):
    df = spark.createDataFrame([(1, f'<all xmlns="http://ex.org/z" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{inner}</all>')], "doc_id int, text string")
    r = typed.read(df, graph, KEY).first()
    assert r.error is None
    return r.value, r.unread


def test_leaves(spark, graph):
    v, unread = one(spark, graph, "<at>2025-03-14T09:00:00.1234567-04:00</at><month>2026-05</month><marks> x  y z</marks><raw>0aFF</raw><b64>AQID</b64><either>12</either><money cur='EUR'>1.50</money><left>3</left><odd/>")
    assert v.at.offset_seconds == -14400 and v.at.ts == datetime.datetime(2025, 3, 14, 13, 0, 0, 123456) and v.at.sub_micros == 700
    assert tuple(v.month) == (2026, 5) and v.marks == ["x", "y", "z"] and bytes(v.raw) == b"\x0a\xff" and bytes(v.b64) == b"\x01\x02\x03"
    assert v.either.text == "12" and v.either.member == 0 and v.money._cur == "EUR" and v.money._VALUE == __import__("decimal").Decimal("1.5")
    assert v.choice.tag == "left" and v.choice.left == 3 and v.choice.right is None and unread == 1


def test_content(spark, graph):
    v, _ = one(spark, graph, "<who id='1'><name>A</name></who><who id='2' xsi:type='worker'><name>B</name><wage>5</wage></who><who><name>C</name><wage>9</wage></who>"
               "<tree><label>r</label><child><label>a</label><child><label>b</label></child></child></tree><open>t<i a='1'>u</i></open><nothing/>"
               "<pick k='z'><q>s</q></pick><many><p>1</p><q id='7'><name>N</name></q><p>2</p></many><pairs><x>1</x><y>2</y><z>k</z><x>3</x><y>4</y></pairs>")
    assert [(w._type, w._id, w.name, w.wage) for w in v.who][:2] == [("org.ex.z/person", 1, "A", None), ("org.ex.z/worker", 2, "B", 5)] and v.who[2].wage is None
    assert v.tree.child[0].child[0].label == "b" and v.open == 't<i a="1">u</i>' and v.nothing is True
    assert v.pick._k == "z" and v.pick.choice.tag == "q" and v.pick.choice.q == "s"
    assert [(i.ord, i.tag) for i in v.many["items"]] == [(1, "p"), (2, "q"), (3, "p")] and v.many["items"][1].q._id == 7 and v.many["items"][2].p == 2
    assert [(i.tag, i.x, i.y, i.z) for i in v.pairs["items"]] == [("x", 1, None, None), ("y", None, 2, None), ("z", None, None, "k"), ("x", 3, None, None), ("y", None, 4, None)]


def test_write_and_read_again(spark, graph):
    inner = ("<at>2025-03-14T09:00:00-04:00</at><month>2026-05</month><marks>x y</marks><raw>0AFF</raw><b64>AQID</b64><either>a &lt; b</either><who id='2' xsi:type='worker'><name>B &amp; C</name><wage>5</wage></who>"
             "<tree><label>r</label><child><label>a</label></child></tree><open>t<i a='1'>u</i></open><nothing/><pick k='z'><q>  s\n</q></pick><many><p>1</p><q id='7'><name>N</name></q><p>2</p></many><pairs><x>1</x><y>2</y></pairs><money cur='E'>1.5</money><right>4</right>")
    df = spark.createDataFrame([(1, f'<all xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{inner}</all>'), (2, "<all/>"), (3, None), (4, "<all>")], "doc_id int, text string")
    first = typed.read(df, graph, KEY)
    again = typed.read(first.select("doc_id", typed.write(F.col("value"), graph, KEY).alias("text")), graph, KEY)
    a, b = ({r.doc_id: r for r in x.collect()} for x in (first, again))
    assert a[1].value == b[1].value and a[1].value.pick.choice.q == "  s\n" and a[2].value == b[2].value
    assert a[3].value is None and a[3].error is None and a[4].error is not None
    assert typed.read(df.limit(0), graph, KEY).count() == 0


def test_content_model(spark, graph):
    node = next(f for f in graph.node(KEY)["fields"] if f["name"] == "pairs")["node"] if graph.node(KEY)["kind"] == "map" else None
    model = typed.content_model(graph, node)
    df = spark.createDataFrame([("<x><y>",), ("<x><y><z><x><y>",), ("<x><z>",), ("",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(f"^(?:{model})$")).collect()] == [True, True, False, False]


def test_render_keeps_white_space(spark):
    df = spark.createDataFrame([("\n  ",), ("a>\n",), (None,)], "b string")
    assert [r[0] for r in df.select(xml_out.render(F.struct("b"), "r")).collect()] == ["<r><b>\n  </b></r>", "<r><b>a>\n</b></r>", "<r/>"]

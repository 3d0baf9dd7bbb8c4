"""Text to typed columns and back, as literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from arborlake.functions import leaf, names


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,back",
    [
        ("2025-03-14T09:00:00-04:00", "2025-03-14T09:00:00-04:00"),
        ("2025-03-14T09:00:00.123456Z", "2025-03-14T09:00:00.123456Z"),
        ("2025-03-14T09:00:00.1234567+05:30", "2025-03-14T09:00:00.1234567+05:30"),
        ("2025-03-14T09:00:00", "2025-03-14T09:00:00Z"),
        ("1925-03-14T09:00:01.5Z", "1925-03-14T09:00:01.5Z"),
        ("not a date", None),
        (None, None),
    ],
)
def test_date_time_keeps_its_offset(spark, text, back):
    assert one(spark, lambda c: leaf.encode_date_time(leaf.decode_date_time(c)), text) == back


@pytest.mark.parametrize("name,text,back", [("dayTimeDuration", "PT15M", "PT15M"), ("dayTimeDuration", "P1DT2H", "PT26H"), ("dayTimeDuration", "-PT1.5S", "-PT1.5S"), ("dayTimeDuration", "PT20S", "PT20S"), ("dayTimeDuration", "PT0S", "PT0S"), ("yearMonthDuration", "P3M", "P3M"), ("yearMonthDuration", "P2Y3M", "P2Y3M"), ("gYear", "2026", "2026"), ("gYearMonth", "2026-05", "2026-05"), ("gMonthDay", "--05-20", "--05-20"), ("gMonth", "--05", "--05"), ("hexBinary", "040506", "040506"), ("base64Binary", "AQID", "AQID"), ("decimal", "1.500", "1.5"), ("decimal", "x", None), ("date", "2025-02-30", None), ("gMonth", "--13", None), ("dayTimeDuration", "P", None)])
def test_round_trips(spark, name, text, back):
    x = leaf.leaf(name)
    assert one(spark, lambda c: x.encode(x.decode(c)), text) == back


def test_booleans_and_lists(spark):
    assert [one(spark, leaf.decode_boolean, t) for t in ("true", " TRUE ", "1", "false", None)] == [True, True, False, False, None]
    assert one(spark, leaf.decode_list, "  a b\n c ") == ["a", "b", "c"]
    assert one(spark, leaf.decode_list, " ") is None
    assert one(spark, lambda c: leaf.decode_union(c, ["int", "date", "string"])["member"], "2025-01-02") == 1


def test_x12_elements(spark):
    assert one(spark, leaf.decode_x12_date, "20240507") == dt.date(2024, 5, 7)
    assert one(spark, leaf.decode_x12_date, "240507") == dt.date(2024, 5, 7)
    assert one(spark, leaf.decode_x12_date, "2405") is None
    assert one(spark, leaf.decode_x12_time, "0815") == "08:15:00.00"
    assert one(spark, lambda c: leaf.encode_x12_time(leaf.decode_x12_time(c), 6), "155401") == "155401"
    assert one(spark, lambda c: leaf.encode_x12_integer(leaf.decode_x12_integer(c), 5), "42") == "00042"
    assert one(spark, leaf.decode_x12_integer, "1234") == 1234
    assert str(one(spark, leaf.decode_x12_implied, "1234"))[:5] == "12.34"


def test_names(spark):
    assert one(spark, names.uri_namespace, "http://www.host.org/2001/Schema") == "org.host.www.2001.Schema"
    assert one(spark, names.uri_namespace, "urn:a:b:c") == "c.b.a"
    assert one(spark, names.slug, "Name, First/Last (X)") == "name-firstlast-x"
    assert one(spark, lambda c: names.module_path(names.module_name(c)), "org.host/basic-link.x") == "org/host/basic_link_x.json"

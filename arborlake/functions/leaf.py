"""Leaf codecs: text to typed columns and back. Text that doesn't fit a type decodes to null and never fails a job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 18)
DATE_TIME = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("offset_seconds", T.IntegerType()), T.StructField("sub_micros", T.IntegerType())])
_DATE_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?)(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})?$"
_DURATION = r"^(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
_PERIOD = r"^(-)?P(?:(\d+)Y)?(?:(\d+)M)?$"


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def _number(c: Column) -> Column:
    """A whole number; nothing counts as 0, one that is too large is null."""
    return F.when(c.isNull(), F.lit(0)).otherwise(c.try_cast("int"))


def decode_boolean(c: Column) -> Column:
    """Only the word true is true; "1" is false, as everything else."""
    return F.lower(F.trim(c)) == "true"


def decode_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def decode_time(c: Column) -> Column:
    """Times stay text, as hours, minutes, seconds and a fraction; anything else is null."""
    return F.when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?$"), c)


def decode_date_time(c: Column) -> Column:
    """Instant, offset of the text (none: 0), and nanoseconds beyond its microseconds."""
    local, zone = _part(c, _DATE_TIME, 1), F.coalesce(_part(c, _DATE_TIME, 3), F.lit("Z"))
    fraction = F.rpad(F.coalesce(_part(c, _DATE_TIME, 2), F.lit("")), 9, "0")
    full = F.concat(local, F.when(F.length(local) == 16, ":00").otherwise(""), F.lit("."), F.substring(fraction, 1, 6), zone)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 5, 2).cast("int") * 60))
    ts = full.try_cast("timestamp")
    return F.when(c.rlike(_DATE_TIME) & ts.isNotNull(), F.struct(ts.alias("ts"), offset.cast("int").alias("offset_seconds"), F.substring(fraction, 7, 3).cast("int").alias("sub_micros")))


def _whole(c: Column, by: int) -> Column:
    """Rounded down, in whole numbers throughout."""
    return F.call_function("div", c - F.pmod(c, F.lit(by)), F.lit(by))


def encode_date_time(c: Column) -> Column:
    micros = F.unix_micros(c["ts"]) + c["offset_seconds"].cast("long") * 1_000_000
    seconds = _whole(micros, 1_000_000)
    days = _whole(seconds, 86400).cast("int")
    clock = F.pmod(seconds, F.lit(86400))
    nanos = F.pmod(micros, F.lit(1_000_000)) * 1000 + F.coalesce(c["sub_micros"], F.lit(0))
    fraction = F.regexp_replace(F.format_string(".%09d", nanos), r"\.?0+$", "")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    offset = F.abs(c["offset_seconds"])
    zone = F.when(c["offset_seconds"] == 0, "Z").otherwise(F.concat(F.when(c["offset_seconds"] < 0, "-").otherwise("+"), two(F.floor(offset / 3600)), F.lit(":"), two(F.floor(offset / 60) % 60)))
    date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.when(c.isNotNull(), F.concat(date, F.lit("T"), two(F.floor(clock / 3600)), F.lit(":"), two(F.floor(clock / 60) % 60), F.lit(":"), two(clock % 60), fraction, zone))


def decode_local_date_time(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), c.try_cast("timestamp_ntz"))


def decode_duration(c: Column) -> Column:
    sign = F.when(_part(c, _DURATION, 1) == "-", -1).otherwise(1)
    days, hours, minutes = (_number(_part(c, _DURATION, k)) for k in (2, 3, 4))
    zero = F.lit(0).cast("decimal(18,6)")
    part = _part(c, _DURATION, 5)
    secs = F.when(part.isNull(), zero).otherwise(part.try_cast("decimal(18,6)"))
    total = days.cast("decimal(20,0)") * 86400 + hours.cast("decimal(20,0)") * 3600 + minutes.cast("decimal(20,0)") * 60 + secs
    fits = F.coalesce(total < 9_000_000_000_000, F.lit(False))  # of 2 ** 63 microseconds; null parts are too large
    keep = lambda x: F.when(fits, sign * x).otherwise(0)
    whole = F.make_dt_interval(keep(days), keep(hours), keep(minutes), F.when(fits, (sign * secs).cast("decimal(18,6)")).otherwise(zero))
    return F.when(c.rlike(_DURATION) & c.rlike(r"\d") & fits, whole)


def encode_duration(c: Column) -> Column:
    """Hours, minutes and seconds; days count as hours."""
    micros = (F.extract(F.lit("DAY"), c).cast("long") * 86400 + F.extract(F.lit("HOUR"), c).cast("long") * 3600 + F.extract(F.lit("MINUTE"), c).cast("long") * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    size = F.abs(micros)
    h, m, s = F.floor(size / 3_600_000_000), F.floor(size / 60_000_000) % 60, size % 60_000_000
    sec = F.regexp_replace(F.format_string("%d.%06d", F.floor(s / 1_000_000).cast("long"), s % 1_000_000), r"\.?0+$", "")
    sec = F.when(s == 0, "").otherwise(F.concat(F.when(s < 10_000_000, F.regexp_replace(F.format_string("%d.%06d", F.floor(s / 1_000_000).cast("long"), s % 1_000_000), r"\.?0{1,6}$", "")).otherwise(F.when(s % 1_000_000 == 0, F.floor(s / 1_000_000).cast("string")).otherwise(sec)), F.lit("S")))
    body = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), sec)
    return F.when(c.isNotNull(), F.when(micros == 0, "PT0S").otherwise(F.concat(F.when(micros < 0, "-").otherwise(""), F.lit("PT"), body)))


def decode_period(c: Column) -> Column:
    sign = F.when(_part(c, _PERIOD, 1) == "-", -1).otherwise(1)
    years, months = (_number(_part(c, _PERIOD, k)) for k in (2, 3))
    fits = F.coalesce(years.cast("long") * 12 + months.cast("long") < 1 << 31, F.lit(False))
    keep = lambda x: F.when(fits, sign * x).otherwise(0)
    return F.when(c.rlike(_PERIOD) & c.rlike(r"\d") & fits, F.make_ym_interval(keep(years), keep(months)))


def encode_period(c: Column) -> Column:
    months = F.extract(F.lit("YEAR"), c).cast("int") * 12 + F.extract(F.lit("MONTH"), c).cast("int")
    size = F.abs(months)
    y, m = F.floor(size / 12), size % 12
    body = F.concat(F.when(y > 0, F.concat(y.cast("string"), F.lit("Y"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(c.isNotNull(), F.when(months == 0, "P0M").otherwise(F.concat(F.when(months < 0, "-").otherwise(""), F.lit("P"), body)))


def decode_year(c: Column) -> Column:
    return F.when(c.rlike(r"^-?\d{4,}$"), c.try_cast("int"))


def decode_year_month(c: Column) -> Column:
    p = r"^(\d{4})-(0[1-9]|1[0-2])$"
    return F.when(c.rlike(p), F.struct(_part(c, p, 1).cast("int").alias("year"), _part(c, p, 2).cast("int").alias("month")))


def encode_year_month(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%04d-%02d", c["year"], c["month"]))


def decode_month_day(c: Column) -> Column:
    p = r"^--(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
    return F.when(c.rlike(p), F.struct(_part(c, p, 1).cast("int").alias("month"), _part(c, p, 2).cast("int").alias("day")))


def encode_month_day(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("--%02d-%02d", c["month"], c["day"]))


def decode_month(c: Column) -> Column:
    p = r"^--(0[1-9]|1[0-2])$"
    return F.when(c.rlike(p), _part(c, p, 1).cast("int"))


def encode_month(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("--%02d", c))


def decode_list(c: Column, item: Callable[[Column], Column] | None = None) -> Column:
    """Items between white space; an empty list is null."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(parts, item) if item else parts)


def decode_union(c: Column, members: list[str]) -> Column:
    """The text, with the number of the first member type that takes it."""
    index = F.coalesce(*[F.when(leaf(m).decode(c).isNotNull(), F.lit(k)) for k, m in enumerate(members)], F.lit(None).cast("int"))
    return F.when(c.isNotNull(), F.struct(c.alias("text"), index.alias("member")))


def decode_tuple(c: Column, members: list[str]) -> Column:
    """Items between white space by their place: a struct _1, _2, ...; null unless there is one for each member."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.when(F.size(parts) == len(members), F.struct(*[leaf(m).decode(F.get(parts, F.lit(k))).alias(f"_{k + 1}") for k, m in enumerate(members)]))


def undecoded(name: str, c: Column) -> Column:
    """Is there text that the type can't take (and that decodes to null)? Numbers too large for 38 digits are among it."""
    return c.isNotNull() & (F.trim(c) != "") & leaf(name).decode(c).isNull()


@dataclass(frozen=True)
class Leaf:
    """A leaf type: its Spark type, and the codecs between it and text."""

    name: str
    data_type: T.DataType
    decode: Callable[[Column], Column]
    encode: Callable[[Column], Column]


def _text(c: Column) -> Column:
    return c


def _cast(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.trim(c).try_cast(kind)


def _string(c: Column) -> Column:
    return c.cast("string")


def encode_decimal(c: Column) -> Column:
    """Plain digits without trailing zeros."""
    s = c.cast("decimal(38,18)").cast("string")
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


LEAVES: dict[str, Leaf] = {}


def register(name: str, data_type: T.DataType, decode: Callable[[Column], Column], encode: Callable[[Column], Column]) -> None:
    """Add or replace a leaf type."""
    LEAVES[name] = Leaf(name, data_type, decode, encode)


def leaf(name: str) -> Leaf:
    return LEAVES.get(name, LEAVES["string"])


#: The builtin types of XML Schema.
for _n in "string normalizedString token language NMTOKEN Name NCName ID IDREF ENTITY untypedAtomic anySimpleType anyURI QName NOTATION duration gDay".split():
    register(_n, T.StringType(), _text, _string)
for _n in "long int short byte unsignedInt unsignedShort unsignedByte".split():
    register(_n, T.LongType(), _cast("bigint"), _string)
for _n in "integer nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong".split():
    register(_n, T.DecimalType(38, 0), _cast("decimal(38,0)"), _string)
for _n in "float double".split():
    register(_n, T.DoubleType(), _cast("double"), _string)
register("decimal", DECIMAL, _cast("decimal(38,18)"), encode_decimal)
register("boolean", T.BooleanType(), decode_boolean, _string)
register("date", T.DateType(), decode_date, _string)
register("time", T.StringType(), decode_time, _string)
register("dateTime", DATE_TIME, decode_date_time, encode_date_time)
register("localDateTime", T.TimestampNTZType(), decode_local_date_time, lambda c: F.regexp_replace(c.cast("string"), " ", "T"))
register("dayTimeDuration", T.DayTimeIntervalType(), decode_duration, encode_duration)
register("yearMonthDuration", T.YearMonthIntervalType(), decode_period, encode_period)
register("gYear", T.IntegerType(), decode_year, lambda c: F.format_string("%04d", c))
register("gYearMonth", T.StructType([T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]), decode_year_month, encode_year_month)
register("gMonthDay", T.StructType([T.StructField("month", T.IntegerType()), T.StructField("day", T.IntegerType())]), decode_month_day, encode_month_day)
register("gMonth", T.IntegerType(), decode_month, encode_month)
register("base64Binary", T.BinaryType(), lambda c: F.try_to_binary(c, F.lit("base64")), lambda c: F.base64(c))
register("hexBinary", T.BinaryType(), lambda c: F.unhex(c), lambda c: F.hex(c))


# X12 elements


def decode_x12_date(c: Column) -> Column:
    """Eight digits, else six."""
    return F.coalesce(F.when(F.length(c) == 8, F.try_to_date(c, "yyyyMMdd")), F.when(F.length(c) == 6, F.try_to_date(c, "yyMMdd")))


def encode_x12_date(c: Column, size: int = 8) -> Column:
    return F.date_format(c, "yyyyMMdd" if size == 8 else "yyMMdd")


def decode_x12_time(c: Column) -> Column:
    """Eight, six or four digits as HH:mm:ss and hundredths."""
    full = F.rpad(c, 8, "0")
    text = F.concat_ws(":", F.substring(full, 1, 2), F.substring(full, 3, 2), F.concat(F.substring(full, 5, 2), F.lit("."), F.substring(full, 7, 2)))
    return F.when(c.rlike(r"^([01]\d|2[0-3])[0-5]\d([0-5]\d(\d\d)?)?$"), text)


def encode_x12_time(c: Column, size: int = 4) -> Column:
    return F.substring(F.regexp_replace(c, r"[:.]", ""), 1, size)


def decode_x12_integer(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("bigint")


def encode_x12_integer(c: Column, least: int = 1) -> Column:
    """Zeros up to the least length."""
    c = c.cast("long")
    text = c.cast("string")
    # padding is much cheaper than a format
    return F.when(c >= 0, F.lpad(text, F.greatest(F.lit(least), F.length(text)), "0")).otherwise(F.format_string(f"%0{least}d", c))


def decode_x12_implied(c: Column, places: int = 2) -> Column:
    """N2 and the like, with the implied point applied (the plain reading keeps the whole number)."""
    return (decode_x12_integer(c).cast("decimal(38,0)") / F.lit(10**places).cast("decimal(38,0)")).cast("decimal(38,18)")


register("x12:ID", T.StringType(), _text, _string)
register("x12:AN", T.StringType(), _text, _string)
register("x12:DT", T.DateType(), decode_x12_date, encode_x12_date)
register("x12:TM", T.StringType(), decode_x12_time, encode_x12_time)
register("x12:R", DECIMAL, lambda c: F.nullif(c, F.lit("")).try_cast("decimal(38,18)"), encode_decimal)
register("x12:N0", T.LongType(), decode_x12_integer, encode_x12_integer)
register("x12:N2", T.LongType(), decode_x12_integer, encode_x12_integer)

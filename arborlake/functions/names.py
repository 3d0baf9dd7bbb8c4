"""Names: keys, namespaces, slugs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def uri_namespace(uri: Column) -> Column:
    """http://host.of/a/b to of.host.a.b, urn:a:b to b.a; other text and null as they are."""
    rest = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    pieces = F.concat(F.reverse(F.split(host, r"\.")), F.split(path, "/"))
    urn = F.reverse(F.split(F.regexp_replace(uri, r"^urn:", ""), ":"))
    join = lambda a: F.array_join(F.filter(a, lambda x: x != ""), ".")
    return F.when(uri.startswith("urn:"), join(urn)).when(uri.contains("://"), join(pieces)).otherwise(uri)


def key(namespace: Column, name: Column, default: str | Column = "") -> Column:
    default = F.lit(default) if isinstance(default, str) else default
    return F.concat_ws("/", F.coalesce(not_empty(namespace), default), name)


def slug(c: Column) -> Column:
    """Without / , ( ), lower case, white space as hyphens."""
    return F.regexp_replace(F.lower(F.translate(c, "/,()", "")), r"\s", "-")


def numbered(name: Column, sequence: Column) -> Column:
    return F.format_string("%s-%s", name, sequence)


def module_name(k: Column) -> Column:
    """Of a key ns/name: ns.name with the dots of the name as underscores."""
    return F.concat(F.substring_index(k, "/", 1), F.lit("."), F.translate(F.element_at(F.split(k, "/"), -1), ".", "_"))


def module_path(module: Column, suffix: str = ".json") -> Column:
    return F.concat(F.translate(module, "-.", "_/"), F.lit(suffix))


def without_suffix(k: Column, suffix: str = "-seq") -> Column:
    return F.when(k.endswith(suffix), F.substring(k, F.lit(1), F.length(k) - len(suffix))).otherwise(k)

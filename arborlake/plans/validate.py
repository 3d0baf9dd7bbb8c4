"""Validation as predicates: what a struct column breaks, as an array of messages. Reading stays lenient; this is asked for apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .xsd import SchemaGraph


def facet_checks(c: Column, facets: dict, where: str) -> list[Column]:
    """Enumeration, length and pattern of a text; nulls pass."""
    out = []
    fail = lambda bad, what: F.when(c.isNotNull() & bad, F.lit(f"{where}: {what}"))
    if "enum" in facets:
        out.append(fail(~c.isin(facets["enum"]), "not in the enumeration"))
    if "min" in facets:
        out.append(fail(F.length(c) < facets["min"], "too short"))
    if "max" in facets:
        out.append(fail(F.length(c) > facets["max"], "too long"))
    number = c.try_cast("decimal(38,18)")
    for name, broken, what in (("minInclusive", lambda v: number < v, "too small"), ("minExclusive", lambda v: number <= v, "too small"), ("maxInclusive", lambda v: number > v, "too large"), ("maxExclusive", lambda v: number >= v, "too large")):
        if name in facets:
            out.append(fail(broken(F.lit(facets[name]).cast("decimal(38,18)")), what))
    digits = F.regexp_replace(F.regexp_replace(c, r"^[-+]?0*", ""), r"(\.\d*?)0+$", "$1")
    if "totalDigits" in facets:
        out.append(fail(F.length(F.regexp_replace(digits, r"[^0-9]", "")) > int(facets["totalDigits"]), "too many digits"))
    if "fractionDigits" in facets:
        out.append(fail(F.length(F.regexp_extract(digits, r"\.(\d*)$", 1)) > int(facets["fractionDigits"]), "too many digits after the point"))
    for p in facets.get("pattern", []):
        out.append(fail(~c.rlike(f"^(?:{p})$"), "pattern"))
    return out


def _checks(graph: SchemaGraph, node: dict, c: Column, where: str, depth: int) -> list[Column]:
    """Checks of a value down to where its type is cut: as deep as the struct is unrolled."""
    node = graph.resolve(node)
    kind = node["kind"]
    if kind == "leaf":
        return facet_checks(c.cast("string"), node.get("facets", {}), where) if node.get("facets") else []
    if kind == "wrapped":
        own = _fields(graph, node["attrs"], c, where, depth)
        inner = graph.resolve(node["value"])
        if inner["kind"] == "leaf":
            return own + _checks(graph, inner, c["_VALUE"], where, depth)
        return own + (_content(graph, inner, c, where, depth) if inner["kind"] in ("choice", "cat", "map") else [])
    return _content(graph, node, c, where, depth)


def _content(graph: SchemaGraph, node: dict, c: Column, where: str, depth: int) -> list[Column]:
    kind = node["kind"]
    if kind == "map":
        return _fields(graph, node["fields"], c, where, depth)
    if kind == "choice":
        return _choice(graph, node, c["choice"], c, where, depth, node.get("min", 1))
    if kind == "cat":
        from .typed import content_model

        tags = F.array_join(F.transform(c["items"], lambda x: F.concat(F.lit("<"), x["tag"], F.lit(">"))), "")
        return [F.when(c.isNotNull() & ~F.coalesce(tags, F.lit("")).rlike(f"^(?:{content_model(graph, node)})$"), F.lit(f"{where}: order of its elements"))]
    return []


def _choice(graph: SchemaGraph, node: dict, choice: Column, parent: Column, where: str, depth: int, least: int) -> list[Column]:
    out = [F.when(parent.isNotNull() & choice.isNull(), F.lit(f"{where}: no choice"))] if least else []
    for arm in node["arms"]:
        if not arm.get("group_arm") and graph.resolve(arm["node"])["kind"] in ("leaf", "map", "wrapped"):
            out += _one(graph, arm["node"], choice[arm["name"]], f"{where}/{arm['name']}", depth)
    return out


def _unary(f):
    return lambda x: f(x)


def _one(graph: SchemaGraph, node: dict, value: Column, where: str, depth: int) -> list[Column]:
    """Of a value in a field; a recursive type counts down, as its struct does."""
    deeper = depth - 1 if node["kind"] == "ref" and graph.is_cyclic(node["key"]) else depth
    return _checks(graph, node, value, where, deeper) if deeper > 0 else []


def _fields(graph: SchemaGraph, fields: list[dict], c: Column, where: str, depth: int) -> list[Column]:
    out = []
    groups: dict[int, list[Column]] = {}
    for f in fields:
        if f.get("inline"):
            out += _choice(graph, f["node"], c["choice"], c, where, depth, f.get("min", 1))
            continue
        name = ("_" if f.get("attr") else "") + f["name"]
        here = f"{where}/{name}"
        value = c[name]
        if f.get("max", 1) != 1 and not f.get("attr"):
            n = F.coalesce(F.size(value), F.lit(0))
            out.append(F.when(c.isNotNull() & (n < f.get("min", 1)), F.lit(f"{here}: too few")))
            if f.get("max") is not None:
                out.append(F.when(n > f["max"], F.lit(f"{here}: too many")))

            def broken(x: Column, node=f["node"], here=here) -> Column:
                bad = F.lit(False)
                for check in _one(graph, node, x, here, depth):
                    bad = bad | check.isNotNull()
                return bad

            if graph.resolve(f["node"])["kind"] in ("leaf", "map", "wrapped", "choice", "cat"):
                out.append(F.when(F.exists(value, _unary(broken)), F.lit(f"{here}: item")))
        else:
            if f.get("min", 1) and f.get("group") is None:
                out.append(F.when(c.isNotNull() & value.isNull(), F.lit(f"{here}: required")))
            if f.get("group") is not None:
                groups.setdefault(f["group"], []).append(value)
            out += _one(graph, f["node"], value, here, depth)
    for k, members in groups.items():
        some = F.lit(False)
        every = F.lit(True)
        for m in members:
            some, every = some | m.isNotNull(), every & m.isNotNull()
        out.append(F.when(some & ~every, F.lit(f"{where}: group {k} is incomplete")))
    return out


def violations(graph: SchemaGraph, value: Column, key: str | None = None, depth: int = 4) -> Column:
    """Array of messages, empty for a valid value. ``depth``: how often recursive types are unrolled, as for the struct that is checked.
    Choices and ordered content are checked on values of :func:`typed.read`."""
    key = key or graph.root
    checks = _checks(graph, graph.node(key), value, key.rpartition("/")[2], depth)
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def unexpected_children(nodes: DataFrame, allowed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Elements whose (parent tag, tag) isn't among the allowed pairs (parent, tag): the closed-world check. A node table with parent_tag isn't
    joined with itself; one without is, by sorted merge, as Spark takes it for as small as the texts' columns and would broadcast it. The
    pairs come from a schema and are broadcast: nodes aren't gathered by their few tags."""
    elems = nodes.where("kind = 'elem'")
    if "parent_tag" in nodes.columns:
        return elems.where("parent_tag is not null").withColumnRenamed("parent_tag", "parent").join(F.broadcast(allowed), ["parent", "tag"], "left_anti")
    parent = elems.select(id_col, F.col("node_id").alias("parent_id"), F.col("tag").alias("parent"))
    return elems.join(parent.hint("merge"), [id_col, "parent_id"]).join(F.broadcast(allowed), ["parent", "tag"], "left_anti")


def occurrence_bounds(nodes: DataFrame, parent: str, child: str, least: int, most: int | None, id_col: str = "doc_id") -> DataFrame:
    """Parents with too few or too many children of a tag: (id, node_id, n)."""
    own, inside = F.col("tag") == parent, F.col("tag") == child
    row = lambda node, own, n: F.struct(F.col(node).alias("node_id"), F.lit(own).alias("own"), F.lit(n).alias("n"))
    mine, its = row("node_id", 1, 0), row("parent_id", 0, 1)
    rows = F.array(mine, its) if parent == child else F.array(F.when(own, mine).otherwise(its))
    # parents and children in one pass over the table
    every = nodes.where((F.col("kind") == "elem") & (own | inside)).select(id_col, F.explode(rows).alias("_r")).select(id_col, "_r.*")
    g = every.groupBy(id_col, "node_id").agg(F.sum("n").alias("n"), F.max("own").alias("own")).where("own = 1").drop("own")
    return g.where((F.col("n") < least) | (F.lit(most is not None) & (F.col("n") > (most or 0))))


def out_of_order(nodes: DataFrame, parent: str, order: list[str], id_col: str = "doc_id") -> DataFrame:
    """Children that come before an earlier sibling's place in the schema order."""
    from pyspark.sql import Window

    p = nodes.where((F.col("kind") == "elem") & (F.col("tag") == parent)).select(id_col, F.col("node_id").alias("parent_id"))
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tag"))
    kids = nodes.where("kind = 'elem'").join(p, [id_col, "parent_id"]).withColumn("place", place)
    before = F.max("place").over(Window.partitionBy(id_col, "parent_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return kids.withColumn("_before", before).where("place < _before").select(id_col, "parent_id", "node_id", "tag")

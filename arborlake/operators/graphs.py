"""Reachability over key tables, and registries as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import module_name, module_path, without_suffix


def scratch(spark) -> str:
    """The cluster's shared folder; a temporary one in local mode alone, where there are no other machines."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborlake-"))
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def until_exit(spark, path: str) -> None:
    """Delete a path when the application ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def _cut(df: DataFrame, name: str) -> DataFrame:
    """A table in the cluster's shared folder, so lineage doesn't grow with the rounds."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/arborlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(seed, key): every key that a seed reaches, itself included. Cycles end, as a round keeps only what is new. Each round doubles the
    length of the paths that it follows from the last one's new keys, so a chain of n keys takes about log n rounds of jumps."""
    jump = _cut(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where("_from is not null and _to is not null").distinct(), "jumps")
    seen = _cut(seeds.select("seed").distinct().select("seed", F.col("seed").alias("key")), "reached")
    count = seen.count()
    while True:
        found = seen.join(jump, seen["key"] == jump["_from"]).select("seed", F.col("_to").alias("key"))
        new = _cut(seen.unionByName(found).distinct(), "reached")
        size = new.count()
        if size == count:
            return new
        seen, count = new, size
        # jumps of twice the length beside the old ones; only those from keys that are in use are made
        used = seen.select(F.col("key").alias("_from")).distinct()
        near = jump.join(used, "_from", "left_semi")
        far = near.select("_from", F.col("_to").alias("_mid")).join(jump.select(F.col("_from").alias("_mid"), "_to"), "_mid").select("_from", "_to")
        jump = _cut(jump.unionByName(far).distinct(), "jumps")


def _doubled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For edges (key, to) of which each key has one: (key, to, n, lo, hi), the n keys from a key on along its path with the least and the
    greatest of them, and the end of the path in ``to``, null where it stops at a key without edge; and the keys on cycles (key, lo). Each
    round follows paths of twice the length. It ends when no path goes on, or when those that do all end on their cycles with the whole
    cycle seen: the ends are as many as a round ago, so the round permutes them, and no path has a new least or greatest key."""
    whole = edges.select("key", "to", F.lit(1).cast("bigint").alias("n"), F.col("key").alias("lo"), F.col("key").alias("hi"))
    stops = edges.select(F.col("to").alias("key")).join(edges.select("key"), "key", "left_anti").distinct()
    stops = stops.select("key", F.lit(None).cast(edges.schema["to"].dataType).alias("to"), F.lit(1).cast("bigint").alias("n"), F.col("key").alias("lo"), F.col("key").alias("hi"))
    now = _cut(whole.unionByName(stops), "paths")
    ends = None
    while True:
        # paths that have stopped don't travel, and null ends never meet in one task
        far = now.select(F.col("key").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        on = now.where("to is not null").join(far.hint("merge"), "to")
        on = on.select("key", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"), ((F.col("_lo") < F.col("lo")) | (F.col("_hi") > F.col("hi"))).alias("moved"))
        now = _cut(on.unionByName(now.where("to is null").withColumn("moved", F.lit(False))), "paths")
        going = now.where("to is not null")
        if going.isEmpty():
            return now, going.select("key", "lo")
        if going.where("moved").isEmpty():
            before, ends = ends, going.select("to").distinct().count()
            if ends == before:
                return now, now.join(going.select(F.col("to").alias("key")).distinct().hint("merge"), "key", "left_semi").select("key", "lo")


def reach(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(seed, n, top): how many keys each seed reaches, itself included, and the greatest. Where every key has one edge at most, paths are
    counted in rounds of doubled length, so tables of keys are all that is held; other graphs go through the pairs of :func:`reachable`."""
    seeds = seeds.select("seed").distinct()
    edges = _cut(edges.select(F.col(source).alias("key"), F.col(target).alias("to")).where("key is not null and to is not null").distinct(), "edges")
    if not edges.groupBy("key").count().where("count > 1").isEmpty():
        return reachable(edges, seeds, "key", "to").groupBy("seed").agg(F.count("*").alias("n"), F.max("key").alias("top"))
    paths, rings = _doubled(edges)
    rings = _cut(rings, "rings")
    # the way to a cycle, then its length: a ring's keys stop the paths, and a path that meets one ends there
    size = rings.groupBy("lo").agg(F.count("*").alias("size"))
    ringed = _cut(rings.join(size.hint("merge"), "lo").select("key", "size"), "rings")
    counted = paths.where("to is null").select("key", "n", "hi")
    if not ringed.isEmpty():
        tail = edges.join(ringed.hint("merge"), "key", "left_anti")
        ways = _ends(tail)
        led = ways.join(ringed.select(F.col("key").alias("end"), "size").hint("merge"), "end").select("key", (F.col("n") + F.col("size")).alias("n"))
        counts = led.unionByName(ringed.select("key", F.col("size").alias("n")))
        counted = counted.unionByName(paths.where("to is not null").select("key", "hi").join(counts.hint("merge"), "key").select("key", "n", "hi"))
    got = seeds.join(counted.hint("merge"), seeds["seed"] == counted["key"], "left")
    return got.select("seed", F.when(F.col("seed").isNotNull(), F.coalesce("n", F.lit(1).cast("bigint"))).alias("n"), F.coalesce("hi", "seed").alias("top"))


def _ends(edges: DataFrame) -> DataFrame:
    """(key, end, n) for edges (key, to) without cycles, one for each key: where the path from a key ends, and its edges up to there."""
    now = _cut(edges.select("key", F.col("to").alias("end"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("goes")), "ways")
    while not (open_ := now.where("goes")).isEmpty():
        far = now.select(F.col("key").alias("end"), F.col("end").alias("_end"), F.col("n").alias("_n"), F.col("goes").alias("_goes"))
        on = open_.join(far.hint("merge"), "end", "left")
        on = on.select("key", F.coalesce("_end", "end").alias("end"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_goes", F.lit(False)).alias("goes"))
        now = _cut(on.unionByName(now.where("not goes")), "ways")
    return now.drop("goes")


def missing_seeds(seeds: DataFrame, registry: DataFrame, key: str = "key") -> DataFrame:
    return seeds.join(registry.select(F.col(key).alias("seed")).distinct(), "seed", "left_anti")


def pivot_sequences(registry: DataFrame, key: str = "key", form: str = "form") -> DataFrame:
    """One row for each base key with its plain form and its -seq form (a key that ends so without a base stays a base)."""
    base = registry.select(F.col(key).alias("_k")).distinct()
    folded = registry.withColumn("_short", without_suffix(F.col(key))).join(base, F.col("_short") == F.col("_k"), "left")
    is_seq = F.col(key).endswith("-seq") & F.col("_k").isNotNull()
    return folded.groupBy(F.when(is_seq, F.col("_short")).otherwise(F.col(key)).alias("base")).agg(F.max(F.when(~is_seq, F.col(form))).alias("plain"), F.max(F.when(is_seq, F.col(form))).alias("seq"))


def path_collisions(registry: DataFrame, key: str = "key") -> DataFrame:
    """Paths that differ in case alone: (path, keys)."""
    paths = registry.select(key, module_path(module_name(F.col(key))).alias("path"))
    return paths.groupBy(F.lower("path").alias("path")).agg(F.array_sort(F.collect_set(key)).alias("keys")).where(F.size("keys") > 1)


def name_collisions(names: DataFrame, name: str = "name") -> DataFrame:
    """Names of which name-seq is declared too."""
    other = names.select(F.col(name).alias("_seq"))
    return names.join(other, F.concat(F.col(name), F.lit("-seq")) == F.col("_seq"), "left_semi")


def own_entries(registry: DataFrame, builtins: DataFrame, key: str = "key", form: str = "form") -> DataFrame:
    """Entries that aren't builtins with the same key and form, in order."""
    return registry.join(builtins, [key, form], "left_anti").orderBy(key)

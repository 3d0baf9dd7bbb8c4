"""Embedding near-duplicates by product quantisation.

Unit vectors are dealt to coarse inverted lists (spherical k-means; centroids closer than MERGE are one). What is left after the
centroid is coded in SUBSPACES codebooks of CODES entries, together with the length of the coding error. A vector searches the PROBES
nearest lists and all whose centroid is nearer than NEAR: distances are sums of table entries, and a list's vector is a
candidate unless its distance exceeds the radius by more than its own coding error, so quantisation loses nothing. Candidates
are compared by exact cosine in double precision; vectors of floats are stored as such, those of doubles as doubles.

Vectors within half the angle of ``cosine`` of their centroid are the core of its list: any two of them are linked, so they are counted
without a comparison, and a large group of near copies costs rows and time in proportion to its size.

Codebooks are fitted on a sample of about SAMPLE distinct vectors; every vector is indexed. Equal vectors are one entry with a weight.
Long lists and those who search them are both cut into blocks, and each meeting of two blocks returns counts and a spanning forest of
its links, never the pairs. A link that only one side's probes see counts for both.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of each length are indexed and searched apart.
Rows with a null id come back without a component; repeated ids are a row each. An empty table gives an empty result.
Results hold only the columns listed, so others can't clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialise, table
from ._graph import components

COSINE = 0.95
SAMPLE = 16384
SUBSPACES, CODES = 8, 64
PROBES, NEAR, MERGE = 8, 0.8, 0.955
BLOCK = 2048
#: Inverted lists at most; longer lists are cut into blocks.
LISTS = 4096
#: Shares of a key that may hold very many rows.
SALTS = 64


def _matrix(column, dim: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64) if len(column) else np.zeros((0, dim))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ c.T - (0 if spherical else 0.5 * (c * c).sum(axis=1))
        own = score.argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if spherical:
            c = unit(np.where(np.abs(c).max(axis=1, keepdims=True) > 0, c, 1.0))
    return c


class Index:
    """Coarse centroids and codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        c = _kmeans(sample, lists, spherical=True)
        keep: list[int] = []
        for i in range(len(c)):
            if not keep or (c[keep] @ c[i]).max() < MERGE:
                keep.append(i)
        self.centroids = c[keep]
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(axis=1)]
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]

    def code(self, x: np.ndarray):
        """List, cosine to its centroid, codes and length of the coding error of unit vectors, and a mask of the lists to search."""
        score = x @ self.centroids.T
        own = score.argmax(axis=1)
        rest = x - self.centroids[own]
        codes = np.stack([(rest[:, p] @ b.T - 0.5 * (b * b).sum(axis=1)).argmax(axis=1) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        error = np.sqrt(((rest - self.decode(codes)) ** 2).sum(axis=1))
        probe = score >= NEAR
        k = min(PROBES, score.shape[1])
        np.put_along_axis(probe, np.argpartition(-score, k - 1, axis=1)[:, :k], True, axis=1)
        return own, score[np.arange(len(x)), own], codes, error, probe

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.dim))
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, p] = b[codes[:, j]]
        return out

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of a list, from tables."""
        rest = x - self.centroids[cell]
        out = np.zeros((len(x), len(codes)), np.float32)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            entries = ((rest[:, p][:, None, :] - b[None]) ** 2).sum(axis=2).astype(np.float32)
            out += entries[:, codes[:, j]]
        return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _of_length(keyed: DataFrame, id_col: str, dim: int, cosine: float, store) -> DataFrame:
    """(key, n_links, component_id) of the vectors of one length."""
    spark = keyed.sparkSession
    kind = keyed.schema[id_col].dataType.simpleString()
    core = float(np.sqrt((1 + cosine) / 2)) + 1e-9  # cosine of half the angle

    def raw(batches):
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten(), store).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("weight"), pa.array([r.tobytes() for r in flat], pa.binary())], ["rep", "weight", "v"])

    reps = keyed.where(F.size("v") == dim).groupBy("key").agg(F.min(id_col).alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    reps = materialise(reps.select("rep", "weight", "v").mapInArrow(raw, f"rep {kind}, weight bigint, v binary"), "distinct")
    n = reps.count()
    sample = reps.where(F.pmod(F.xxhash64("v"), F.lit(max(1, -(-n // SAMPLE)))) == 0).select("v").orderBy("v").limit(2 * SAMPLE).collect()
    if not sample:
        sample = reps.select("v").orderBy("v").limit(1).collect()
    fitted = unit(np.frombuffer(b"".join(bytes(r.v) for r in sample), store).reshape(-1, dim).astype(np.float64))
    shared = spark.sparkContext.broadcast(Index(fitted, max(1, min(LISTS, n // 256, len(sample)))))

    def assign(batches):
        for batch in batches:
            own, near, codes, error, probe = shared.value.code(unit(_matrix(batch.column("v"), dim, store)))
            probes = [np.flatnonzero(p).tolist() for p in probe]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "weight", "v")), pa.array(own), pa.array(near >= core), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int64()))], ["rep", "weight", "v", "cell", "core", "codes", "error", "probes"])

    coded = materialise(reps.mapInArrow(assign, f"rep {kind}, weight bigint, v binary, cell bigint, core boolean, codes binary, error double, probes array<bigint>"), "coded")
    # a list's members outside its core are blocks 0 to n_loose - 1, its core the blocks after them; whoever searches it is dealt to n_search blocks
    held = coded.groupBy(F.col("cell").alias("at")).agg(F.count(F.when(~F.col("core"), 1)).alias("loose"), F.count(F.when(F.col("core"), 1)).alias("tight"))
    asked = coded.select(F.explode("probes").alias("at")).groupBy("at").agg(F.count("*").alias("asked"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = materialise(held.join(asked, "at").select("at", blocks("loose").alias("n_loose"), blocks("tight").alias("n_tight"), blocks("asked").alias("n_search")), "lists")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), n).cast("int")
    each = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    members = coded.withColumnRenamed("cell", "at").join(sizes, "at")
    members = members.withColumn("block", F.when(F.col("core"), F.col("n_loose") + deal(1, F.col("n_tight"))).otherwise(deal(1, F.col("n_loose"))))
    members = members.withColumn("search", each(F.col("n_search"))).select("at", "block", "search", "rep", "weight", "v", "core", "codes", "error", "probes")
    queries = coded.select(F.explode("probes").alias("at"), "rep", "weight", "v", "cell", "core").join(sizes, "at").withColumn("search", deal(2, F.col("n_search")))
    inside = F.col("core") & (F.col("at") == F.col("cell"))  # counted with its list's core already
    queries = queries.withColumn("block", each(F.when(inside, F.col("n_loose")).otherwise(F.col("n_loose") + F.col("n_tight")))).select("at", "block", "search", "rep", "weight", "v", "cell")
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def meet(q: pa.Table, m: pa.Table) -> pa.Table:
        id_type = pa.from_numpy_dtype(np.asarray(q.column("rep")).dtype) if q.num_rows else pa.int64()
        schema = pa.schema([("a", id_type), ("b", id_type), ("n", pa.int64())])
        if not q.num_rows or not m.num_rows:
            return schema.empty_table()
        index = shared.value
        cell = q.column("at")[0].as_py()
        mv = unit(_matrix(m.column("v"), dim, store))
        m_rep, m_weight, m_error = (np.asarray(m.column(c)) for c in ("rep", "weight", "error"))
        codes = np.frombuffer(b"".join(m.column("codes").to_pylist()), np.uint8).reshape(len(mv), -1)
        q_rep, q_weight, q_cell = (np.asarray(q.column(c)) for c in ("rep", "weight", "cell"))
        known = np.zeros((len(mv), len(index.centroids)), bool)
        for i, p in enumerate(m.column("probes").to_pylist()):
            known[i, p] = True
        every = np.unique(np.concatenate((q_rep, m_rep)))
        qi, mi = np.searchsorted(every, q_rep), np.searchsorted(every, m_rep)
        total = np.zeros(len(every), np.int64)
        ea, eb = [], []
        limit = ((radius + m_error) ** 2 + 1e-6).astype(np.float32)
        for lo in range(0, len(q_rep), 256):
            qv = unit(_matrix(q.column("v").slice(lo, 256), dim, store))
            x, y = np.nonzero(index.distances(qv, cell, codes) <= limit)
            exact = (qv[x] * mv[y]).sum(axis=1) >= cosine
            x, y = x[exact] + lo, y[exact]
            other = q_rep[x] != m_rep[y]
            x, y = x[other], y[other]
            np.add.at(total, qi[x], m_weight[y])
            unseen = ~known[y, q_cell[x]]  # the member's own search doesn't come here
            np.add.at(total, mi[y[unseen]], q_weight[x[unseen]])
            for a, b in _forest(len(every), qi[x], mi[y]):
                ea.append(a)
                eb.append(b)
        forest = _forest(len(every), np.array(ea, np.int64), np.array(eb, np.int64))
        some = np.flatnonzero(total)
        a = np.concatenate((every[some], every[[f[0] for f in forest]])) if len(every) else every
        b = np.concatenate((every[some], every[[f[1] for f in forest]])) if len(every) else every
        return pa.table([pa.array(a, id_type), pa.array(b, id_type), pa.array(np.concatenate((total[some], np.zeros(len(forest), np.int64))))], schema=schema)

    queries, members = queries.toDF(*queries.columns), members.toDF(*members.columns)
    by = ("at", "block", "search")
    met = materialise(queries.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(meet, f"a {kind}, b {kind}, n bigint"), "met")
    tight = coded.where("core").groupBy("cell").agg(F.min("rep").alias("least"), F.sum("weight").alias("all"))
    counted = coded.where("core").join(F.broadcast(tight), "cell")  # a row for each list, LISTS at most
    counts = met.where("n > 0").select(F.col("a").alias("rep"), "n").unionByName(counted.select("rep", (F.col("all") - F.col("weight")).alias("n")))
    counts = counts.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(met.where("n = 0").select("a", "b").unionByName(counted.select(F.col("rep").alias("a"), F.col("least").alias("b"))))
    out = reps.select("rep", "weight").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    out = out.select("rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return keyed.where(F.size("v") == dim).groupBy("key").agg(F.min(id_col).alias("rep")).join(out, "rep").drop("rep")


def links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row: id, n_links (other vectors linked directly), component_id (smallest id reached), kept."""
    store = np.float32 if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else np.float64
    vector = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    keyed = df.select(F.col(id_col), F.when(good, vector).alias("v"))
    keyed = keyed.withColumn("key", F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.col("v").cast("string"))))).withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    keyed = materialise(keyed, "vectors")
    widths = [r.n for r in keyed.where("v is not null").select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    if not widths:
        return df.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    by_key = reduce(DataFrame.unionByName, [_of_length(keyed, id_col, dim, cosine, store) for dim in widths])
    # many equal vectors are not one key: their answer goes to salted shares
    by_key = keyed.where("key is not null").select("key", "salt").distinct().join(by_key, "key")
    out = keyed.select(F.col(id_col), "key", "salt").join(by_key, ["key", "salt"], "left")
    out = out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark, sf_dir) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))

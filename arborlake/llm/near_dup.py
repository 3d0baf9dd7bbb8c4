"""Near duplicates by ProbMinHash.

Each shingle of five words is a weighted element: its arrivals at the registers are a Poisson process whose rate is its count in
the text. A register keeps the first arrival; a text's process ends as soon as its next arrivals come after all registers' first ones.
Two texts agree in a register with the probability Jaccard similarity of their shingles. Registers are banded; a band's bucket links
its texts with its smallest id, and each such pair is verified on the exact weights of its shingles. Texts that a leader turns
away are dealt a new leader among themselves, LEADERS times. The texts of a bucket that aren't all linked by then are compared in
blocks, those outside its largest linked part with every text that they aren't linked with, on their exact weights. Classes are those of all pairs of all buckets,
but pairs never leave the tasks, only forests that span them do.

Texts are compared whole. Equal texts are one class. Null and empty texts, and those without words, only join with equal ones
(null counts as empty). Rows with a null id stay alone and keep it; repeated ids are one document, which is in the classes of all
its texts and is compared by the one with the least digest. Results hold only
the columns listed, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, mix64, ragged_gather, release, slices, table, texts_of
from ._graph import components
from ._words import shingles, words

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 8
LEADERS = 2
#: Texts, and their elements, on each side of a comparison of two blocks of a bucket.
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 21
#: Shares of a key that may hold very many rows.
SALTS = 64
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, in the order of texts and hashes."""
    h, t = shingles(words(texts), k)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m: the element that comes first at each register of each text; zeros for texts without elements."""
    first = np.full(n * m, np.inf)
    won = np.zeros(n * m, np.uint64)
    ends = np.full(n, np.inf)
    time = np.zeros(len(h))
    k = 0
    while len(h):
        k += 1
        r = mix64(h + np.uint64(k * int(GOLDEN) % (1 << 64)))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        live = time < ends[text]
        text, h, weight, time, r = text[live], h[live], weight[live], time[live], r[live]
        slot = text * m + (mix64(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        win = first[slot] == time
        won[slot[win]] = h[win]
        touched = np.unique(text)
        ends[touched] = first.reshape(n, m)[touched].max(axis=1)
    return won.reshape(n, m)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets with sorted distinct hashes."""
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)] = wa
    y[np.searchsorted(every, hb)] = wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    sx = np.concatenate(([0], np.cumsum(x[order])))
    sy = np.concatenate(([0], np.cumsum(y[order][::-1])))[::-1]
    r = ratio[both]
    cut = np.searchsorted(ratio[order], r, "right")
    return float((x[both] / (sx[cut] + sy[cut] / r)).sum())


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc, text_key, bands: keys of the bands, null without words."""

    def run(batches):
        salt = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                t, h, w = weighted(texts_of(part, text_col))
                sig = prob_min_hash(t, h, w, part.num_rows, bands * rows).reshape(part.num_rows, bands, rows)
                key = np.broadcast_to(salt, (part.num_rows, bands)).copy()
                for j in range(rows):
                    key = mix64(key ^ sig[:, :, j])
                some = np.zeros(part.num_rows, bool)
                some[t] = True
                listed = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text_key"), pc.if_else(pa.array(some), listed, None)], ["doc", "text_key", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    keyed = keyed.withColumn("text_key", F.unhex(F.md5(text_col)))
    return keyed.mapInArrow(run, f"doc {kind}, text_key binary, bands array<bigint>")


def _elements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                t, h, w = weighted(texts_of(part, text_col))
                cut = np.searchsorted(t, np.arange(part.num_rows + 1))
                hs = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                ws = [b"" if (w[a:b] == 1).all() else w[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(hs, pa.binary()), pa.array(ws, pa.binary()), pa.array(np.diff(cut))], ["doc", "h", "w", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc {kind}, h binary, w binary, n bigint")


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), by), F.lit(SALTS)).cast("int"))


def _verified(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """(doc, leader, ok) of (doc, leader). A leader of very many texts is dealt to SALTS places, and only to those that need it."""

    def run(batches):
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("h", "w", "h2", "w2")}
            ok = []
            for ha, wa, hb, wb in zip(c["h"], c["w"], c["h2"], c["w2"], strict=True):
                a, b = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
                wa = np.frombuffer(wa, np.float32) if wa else np.ones(len(a))
                wb = np.frombuffer(wb, np.float32) if wb else np.ones(len(b))
                ok.append(probability_jaccard(a, wa, b, wb) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("leader"), pa.array(ok, pa.bool_())], ["doc", "leader", "ok"])

    kind = pairs.schema["doc"].dataType.simpleString()
    pairs = _salted(pairs, "doc")
    right = elements.select(F.col("doc").alias("leader"), F.col("h").alias("h2"), F.col("w").alias("w2"))
    right = pairs.select("leader", "salt").distinct().join(right, "leader")
    return pairs.join(elements, "doc").join(right, ["leader", "salt"]).select("doc", "leader", "h", "w", "h2", "w2").mapInArrow(run, f"doc {kind}, leader {kind}, ok boolean")


def _bridges(part: np.ndarray, side: np.ndarray, h: list[np.ndarray], w: list[np.ndarray | None], threshold: float) -> list[tuple[int, int]]:
    """Pairs of places that join the parts as far as similar texts of both sides do: a spanning forest over the parts. All pairs of
    different sides and parts are compared exactly, one text against many; only those that an earlier pair has joined are passed over."""
    size = np.array([len(x) for x in h])
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    every, element = np.unique(np.concatenate(h), return_inverse=True)
    # weights as shares of their text: the overlap of shares is the Jaccard of plain sets of one size, and never below the probability Jaccard
    share = np.concatenate([np.full(len(x), 1 / len(x)) if y is None else y / y.sum(dtype=np.float64) for x, y in zip(h, w, strict=True)])
    plain = np.array([y is None for y in w])
    full = [np.ones(len(x)) if y is None else y for x, y in zip(h, w, strict=True)]
    mark = np.zeros(len(every))
    part = part.copy()
    found = []
    for i in np.flatnonzero(side == 1).tolist():
        to = np.flatnonzero((side == 0) & (part != part[i]))
        if not len(to):
            continue
        mine = slice(start[i], start[i] + size[i])
        mark[element[mine]] = share[mine]
        at = ragged_gather(start[to], size[to])
        cut = np.concatenate(([0], np.cumsum(size[to])))[:-1]
        bound = np.add.reduceat(np.minimum(mark[element[at]], share[at]), cut)
        mark[element[mine]] = 0
        near = bound >= threshold - 1e-9
        to, bound = to[near], bound[near]
        # between plain sets the overlap of shares tells how many elements are shared
        shared = np.rint(bound * np.maximum(size[to], size[i]))
        exact = np.where(plain[to] & plain[i], shared / (size[to] + size[i] - shared), np.nan)
        keep = np.flatnonzero(np.isnan(exact) | (exact >= threshold - 1e-9))
        for k in keep[np.argsort(-bound[keep], kind="stable")].tolist():
            j, s = int(to[k]), exact[k]
            if part[i] == part[j]:
                continue
            if np.isnan(s) or abs(s - threshold) < 1e-9:
                s = probability_jaccard(h[i], full[i], h[j], full[j])
            if s >= threshold:
                found.append((i, j))
                part[part == part[j]] = part[i]
    return found


def _between_parts(bucket: DataFrame, part: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """(doc, leader) that join the parts of a bucket. Texts of its largest part need not meet each other, so all texts that are outside it
    (the rest) meet all texts of the bucket. Both are cut into blocks of about BLOCK texts, and a block of each meet in a task of
    their own, which returns a forest: the work is the bucket times its rest, and no pairs leave a task."""
    kind = bucket.schema["doc"].dataType.simpleString()
    rows = bucket.join(part.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("part"))
    rows = rows.join(elements.select("doc", "n"), "doc")
    by_part = rows.groupBy("key", "part").agg(
        F.count("*").alias("members"), F.sum("n").alias("n"),
        F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("one"), F.sum(F.xxhash64(F.lit(1), "doc").cast("decimal(38,0)")).alias("two"),
    )
    sizes = by_part.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("members").alias("members"), F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"),
        F.max(F.struct("members", "n", "part")).alias("main"),
    )
    # the pair of a bucket of two has been verified; buckets of the same texts are compared once
    sizes = sizes.where("parts > 1 and members > 2").groupBy("members", "one", "two").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("main").alias("main"))
    blocks = lambda texts, n: F.greatest(F.ceil(texts / BLOCK), F.ceil(n / BLOCK_ELEMENTS)).cast("int")
    sizes = sizes.select("key", F.col("main.part").alias("main"), blocks(F.col("members"), F.col("n")).alias("n_all"), blocks(F.col("members") - F.col("main.members"), F.col("n") - F.col("main.n")).alias("n_rest"))
    rows = rows.drop("n").join(sizes, "key")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = rows.select("key", "doc", "part", F.lit(0).alias("side"), deal(5, F.col("n_all")).alias("one"), each(F.col("n_rest")).alias("two"))
    rest = rows.where("part <> main").select("key", "doc", "part", F.lit(1).alias("side"), each(F.col("n_all")).alias("one"), deal(6, F.col("n_rest")).alias("two"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("doc", "ascending")])
        kept = t.schema.field("doc").type
        doc = t.column("doc").combine_chunks()
        h = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
        w = [np.frombuffer(x, np.float32) if x else None for x in t.column("w").to_pylist()]
        part = np.unique(np.asarray(t.column("part")), return_inverse=True)[1]
        pairs = np.array(_bridges(part, np.asarray(t.column("side")), h, w, threshold), np.int64).reshape(-1, 2)
        one, two = doc.take(pa.array(pairs[:, 0])), doc.take(pa.array(pairs[:, 1]))
        del t, h, w
        release()
        return pa.table({"doc": pc.max_element_wise(one, two).cast(kept), "leader": pc.min_element_wise(one, two).cast(kept)})

    met = every.unionByName(rest).join(elements.select("doc", "h", "w"), "doc")
    return met.groupBy("key", "one", "two").applyInArrow(compare, f"doc {kind}, leader {kind}").distinct()


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row: id, class_id (the smallest id of its class), kept (is it that document?)."""
    sig = materialise(signatures(df, id_col, text_col, bands, rows), "signatures")
    # classes of equal texts; the smallest id of a text travels back to its salted shares, so a text with very many copies isn't one key
    dealt = _salted(sig.select("doc", "text_key"), "doc")
    shares = dealt.groupBy("text_key", "salt").agg(F.min("doc").alias("least"))
    rep = shares.select("text_key", "salt").join(shares.groupBy("text_key").agg(F.min("least").alias("rep")), "text_key")
    member = materialise(dealt.join(rep, ["text_key", "salt"]).groupBy("doc").agg(F.min("rep").alias("rep"), F.min("text_key").alias("text_key")), "equal")
    own = member.where("doc = rep").select("doc", "text_key")
    # a repeated id stands for its text with the least key, here and in its elements
    rows_ = sig.where("bands is not null").join(own, ["doc", "text_key"], "left_semi").groupBy("doc").agg(F.first("bands").alias("bands")).select("doc", F.explode("bands").alias("key"))
    held = rows_.groupBy("key").agg(F.min("doc").alias("leader"), F.max("doc").alias("other")).where("leader < other").select("key", "leader")
    bucket = materialise(rows_.join(held, "key").select("key", "doc", "leader"), "buckets")
    ids = bucket.select("doc").distinct().join(member, "doc").select(F.col("doc").alias(id_col), F.col("text_key").alias("_text_key"))
    texts = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).withColumn("_text_key", F.unhex(F.md5(text_col)))
    elements = materialise(_elements(texts.join(ids, [id_col, "_text_key"], "left_semi").dropDuplicates([id_col]), id_col, text_col), "elements")
    seen, led = None, bucket
    for _ in range(LEADERS):
        pairs = led.where("doc <> leader").select("doc", "leader").distinct()
        if seen is not None:
            pairs = pairs.join(seen.select("doc", "leader"), ["doc", "leader"], "left_anti")
        got = materialise(_verified(pairs, elements, threshold), "pairs")
        seen = got if seen is None else seen.unionByName(got)
        turned = led.join(seen.where("not ok").select("doc", "leader"), ["doc", "leader"]).select("key", "doc")
        held = turned.groupBy("key").agg(F.min("doc").alias("leader"), F.max("doc").alias("other")).where("leader < other").select("key", "leader")
        following = materialise(turned.join(held, "key").select("key", "doc", "leader"), "buckets")
        if led is not bucket:
            discard(led)
        led = following
    discard(led)
    links = seen.where("ok").select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    found = components(links)
    bridges = materialise(_between_parts(bucket, found, elements, threshold), "pairs")
    discard(bucket)
    if not bridges.isEmpty():
        found = components(links.unionByName(bridges.select(F.col("doc").alias("a"), F.col("leader").alias("b"))))
    discard(elements, sig)
    out = member.join(found, member.rep == found.node, "left").select(F.col("doc").alias(id_col), F.coalesce("component", "rep").alias("class_id"))
    out = df.select(id_col).join(out, id_col, "left").select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("class_id")))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, whose id is the smallest of its class; rows with a null id stay."""
    gone = near_duplicate_classes(df, id_col, text_col, **options).where(~F.col("kept")).select(id_col)
    return df.join(materialise(gone, "near-duplicates"), id_col, "left_anti").select(df.columns)


def op1_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))

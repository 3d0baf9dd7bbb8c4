"""Exact substring dedup by prefix-free parsing.

A rolling hash of TRIGGER bytes is taken at each place. The least one inside a string of ``size`` bytes is its trigger, which
depends on that string alone, so equal strings have equal triggers wherever they stand. Neighbouring strings with one trigger
make a phrase; the phrases of a text, overlapping by size - 1 bytes, are its parse, and the distinct ones are the dictionary.

1. Blocks of texts are parsed; each block sends its distinct phrases with their smallest id to buckets by trigger.
2. A bucket sorts them by trigger and phrase, and answers with the smallest id of each trigger and each phrase. A trigger seen in
   one document clears its phrase; a phrase with a smaller id elsewhere is removed whole.
3. What is left are phrases that share a trigger but differ. They are parsed once more with longer triggers, which clears most.
4. Of the rest each block sorts the suffixes of its dictionary to the depth of ``size`` bytes, and sends each distinct string of that
   suffix array once, with its smallest id, to be merged over all blocks.
5. Each block joins the answers with its parse, marks the bytes covered, and cuts them.

Blocks are folded before each shuffle, so a passage in every document costs one entry a block; of more than FAN blocks, groups of
blocks are folded in turn, so a task gets FAN entries of a string at most, however often the corpus has it.
Between the steps only the blocks and digests of strings travel (64 bits and a further 32). The tables of each step are in the
shared folder.

Null texts are empty. Documents with a null id neither lose nor give anything. Rows of one id don't remove each other. Texts shorter
than ``size`` bytes stay as they are. Results hold only the columns listed, so others can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._common import discard, materialise, mix64, plan_bytes, ragged_gather, release, slices, table, texts_of

SIZE = 50
TRIGGERS = (16, 34)
#: Text bytes of a block, and of a run that is parsed at once.
BLOCK_BYTES = 2 << 20
RUN_BYTES = 1 << 19
#: Input bytes for each bucket, and the fewest buckets.
BUCKET_BYTES = 6 << 20
LEAST_BUCKETS = 64
#: Blocks (or groups of blocks) whose rows of a bucket meet in one task.
FAN = 1 << 14


def parse(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, size: int = SIZE, k: int = TRIGGERS[0]):
    """Phrases of the texts that start at ``first``: start, number of strings of ``size`` bytes, trigger, digest, text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    total = _words.sums(data)
    back = _words.inverse_powers(n)
    g = mix64((total[k:] - total[:-k]) * back[: n - k + 1])
    width, least = 1, g
    window = size - k + 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    m = n - size + 1
    least = np.minimum(least[:m], least[window - width : window - width + m])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(first, first + sizes - size + 1), 1)
    np.add.at(edge, first + sizes, -1)
    valid = np.cumsum(edge[:m]) == 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    count = np.flatnonzero(stop) - start + 1
    digest = mix64((total[start + count + size - 1] - total[start]) * back[start] + count.astype(np.uint64))
    text = np.searchsorted(first, start, "right") - 1
    return start, count, mix64(least[start]), digest, text  # least hashes crowd at zero; mixed, they fill the buckets evenly


def parse_in_runs(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, size: int, k: int):
    """:func:`parse` of runs of whole texts of about RUN_BYTES, to bound the memory for arrays by place."""
    out = []
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first + sizes, first[lo] + RUN_BYTES, "right")))
        at = int(first[lo])
        start, count, trigger, digest, text = parse(data[at : int(first[hi - 1] + sizes[hi - 1])], first[lo:hi] - at, sizes[lo:hi], size, k)
        out.append((start + at, count, trigger, digest, text + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else parse(data, first, sizes, size, k)


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the first ``depth`` bytes of the suffix at each place (ends are padded): prefix doubling, started from eight bytes."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(depth + 8, np.uint8))).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for j in range(min(8, depth)):
        rank = (rank << np.uint64(8)) | padded[j : j + n]
    have = min(8, depth)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while have < depth:
        step = min(have, depth - have)
        after = np.concatenate((rank[step:], np.zeros(min(step, n), np.uint64)))[:n]
        rank = np.unique((rank << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint64)
        have += step
    return rank.astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges, so sorted digests are in the order of buckets."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of about BLOCK_BYTES of text; rest: the other columns of its documents."""
    others = [c for c in df.columns if c not in (id_col, text_col)]

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, text_col, BLOCK_BYTES):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(part, text_col)]
                whole = pa.array([0, len(raw)], pa.int32())
                rest = pa.ListArray.from_arrays(whole, part.column("rest"))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.ListArray.from_arrays(whole, part.column(id_col)), pa.array([list(map(len, raw))], pa.list_(pa.int64())), pa.array([b"".join(raw)], pa.binary()), rest], ["block", "ids", "sizes", "data", "rest"])
                k += 1

    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    source = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), rest.alias("rest"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()), T.StructField("rest", T.ArrayType(source.schema["rest"].dataType))])
    return source.mapInArrow(run, schema)


class _Block:
    def __init__(self, ids: list, sizes: list, data: bytes, size: int, k: int = TRIGGERS[0]):
        self.listed = ids
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(data, np.uint8)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.start, self.count, trigger, digest, text = parse_in_runs(self.data, self.first, self.sizes, size, k)
        known = np.array([i is not None for i in ids], bool)[text] if len(text) else np.zeros(0, bool)
        self.start, self.count, trigger, digest, text = (x[known] for x in (self.start, self.count, trigger, digest, text))
        self.text = text
        self.doc = self.ids[text] if len(text) else np.zeros(0, np.int64)
        order = np.lexsort((self.doc, digest, trigger))
        t, d = trigger[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        self.trigger, self.digest, self.least = t[at], d[at], self.doc[order][at]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def judge(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each phrase: does a smaller id have it whole; is it the first of its kind in a trigger of several documents (open); is
        it open, with a smaller id in its trigger?"""
        rows = sorted(answers.to_pylist(), key=lambda x: x["bucket"])
        state = np.frombuffer(b"".join(x["state"] for x in rows), np.uint8)
        by_trigger, by_phrase = self.least.copy(), self.least.copy()
        by_trigger[state > 0] = np.frombuffer(b"".join(x["by_trigger"] for x in rows), np.int64)
        by_phrase[state > 0] = np.frombuffer(b"".join(x["by_phrase"] for x in rows), np.int64)
        e = self.entry
        whole = by_phrase[e] < self.doc
        open_ = (state[e] == 3) & (by_phrase[e] == self.doc)
        return whole, open_, open_ & (by_trigger[e] < self.doc)


def _cuts(h: np.ndarray, buckets: int):
    b = _bucket(h, buckets)
    edges = np.searchsorted(b, np.arange(buckets + 1))
    return [(k, int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges)).tolist()]


def _fan_in(source: DataFrame, blocks: int, answer, fold, unfold, shape: str, name: str) -> DataFrame:
    """``answer`` for the rows (block, bucket, entries) of each bucket. Of more than FAN blocks, ``fold`` leaves one entry of each string
    to a team of blocks, the teams are answered as blocks are, and ``unfold`` hands the answers on to the blocks of a team."""
    if blocks <= FAN:
        return source.groupBy("bucket").applyInArrow(answer, shape)
    teams = -(-blocks // FAN)
    rows = materialise(source, f"{name}-rows")
    part = F.floor(F.col("bucket") / teams).alias("part")  # a team has a share of each bucket, so several make a task
    placed = rows.select("*", F.pmod(F.xxhash64("block"), F.lit(teams)).alias("team"), part)
    upper = _fan_in(placed.groupBy("team", "part").applyInArrow(fold, rows.schema), teams, answer, fold, unfold, shape, name)
    of_teams = upper.select("*", F.col("block").alias("team"), part)
    out = materialise(placed.groupBy("team", "part").cogroup(of_teams.groupBy("team", "part")).applyInArrow(unfold, shape), name)
    discard(rows, upper)
    return out


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, spans (array of start, end in bytes), kept_sha256."""
    blocks, answers = _answers(df.select(id_col, text_col), id_col, text_col, size)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string())])
        out = [{id_col: i, "n_bytes": n, "n_removed": removed, "n_spans": len(edges) // 2, "spans": edges, "kept_sha256": hashlib.sha256(kept).hexdigest()} for i, n, removed, edges, kept in _cut(left, right, size)]
        return pa.Table.from_pylist(out, schema)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept_sha256 string")


def remove_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", size: int = SIZE) -> DataFrame:
    """The rows of ``df`` with repeated passages cut out of their texts; characters cut in two at an edge are dropped whole.
    ``length_col``, where there is such a column, gets the new length in characters. A null text stays null."""
    blocks, answers = _answers(df, id_col, text_col, size)
    others = [c for c in df.columns if c not in (id_col, text_col)]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [kept.decode("utf-8", "ignore") for *_, kept in _cut(left, right, size)]
        ids = pa.concat_arrays([c.flatten() for c in left.column("ids").chunks])
        rest = pa.concat_arrays([c.flatten() for c in left.column("rest").chunks])
        columns = {id_col: ids, text_col: pa.array(texts, pa.string())} | {c: rest.field(k) for k, c in enumerate(others)}
        if length_col in others:
            columns[length_col] = pa.array(list(map(len, texts)), columns[length_col].type)
        return pa.table([columns[c] for c in df_columns], names=df_columns)

    df_columns = df.columns
    schema = T.StructType([T.StructField(f.name, T.LongType()) if f.name == id_col else f for f in df.schema])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def _answers(df: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the texts, and for each the strings that are repeated."""
    buckets = max(LEAST_BUCKETS, plan_bytes(df.select(id_col, text_col), text_col) // BUCKET_BYTES)
    blocks = materialise(_blocks(df, id_col, text_col), "blocks")
    bodies = blocks.drop("rest")
    n_blocks = blocks.count()

    entries = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("trigger", pa.binary()), ("digest", pa.binary()), ("doc", pa.binary())])

    def sent(b: _Block, block: int) -> list[dict]:
        return [{"bucket": k, "block": block, "trigger": b.trigger[x:y].tobytes(), "digest": b.digest[x:y].tobytes(), "doc": b.least[x:y].tobytes()} for k, x, y in _cuts(b.trigger, buckets)]

    def phrases(batches):
        for batch in batches:
            for r in batch.select(["block", "ids", "sizes", "data"]).to_pylist():
                rows = sent(_Block(r["ids"], r["sizes"], r["data"], size), r["block"])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, entries)

    def in_order(t: pa.Table):
        """The rows; trigger, phrase and least id of the entries, sorted; the order; where triggers and phrases begin; which each entry has."""
        r = t.to_pydict()
        v, p, doc = (np.frombuffer(b"".join(r[k]), kind) for k, kind in (("trigger", np.uint64), ("digest", np.uint64), ("doc", np.int64)))
        order = np.lexsort((p, v))
        v, p, doc = v[order], p[order], doc[order]
        new_v = np.ones(len(v), bool)
        new_v[1:] = v[1:] != v[:-1]
        new_p = new_v.copy()
        new_p[1:] |= p[1:] != p[:-1]
        return r, v, p, doc, order, np.flatnonzero(new_v), np.flatnonzero(new_p), np.cumsum(new_v) - 1, np.cumsum(new_p) - 1

    def told(r: dict, order: np.ndarray, *by_order: np.ndarray) -> pa.Table:
        """State, least id of the trigger and of the phrase of each entry, as a row for each row asked."""
        state, gv, gp = (np.empty(len(order), x.dtype) for x in by_order)
        state[order], gv[order], gp[order] = by_order
        ends = np.cumsum([len(x) // 8 for x in r["trigger"]]).tolist()
        out = []
        for block, bucket, b, a in zip(r["block"], r["bucket"], ends, [0, *ends[:-1]], strict=True):
            some = state[a:b] > 0
            out.append({"block": block, "bucket": bucket, "state": state[a:b].tobytes(), "by_trigger": gv[a:b][some].tobytes(), "by_phrase": gp[a:b][some].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("state", pa.binary()), ("by_trigger", pa.binary()), ("by_phrase", pa.binary())]))

    def meet(t: pa.Table) -> pa.Table:
        r, _, _, doc, order, at_v, at_p, of_v, of_p = in_order(t)
        least_v, least_p = np.minimum.reduceat(doc, at_v), np.minimum.reduceat(doc, at_p)
        last_p = np.maximum.reduceat(least_p[of_p], at_v)
        alone = np.diff(np.append(at_v, len(doc))) == 1
        state = np.where(alone[of_v], 0, np.where((last_p > least_v)[of_v], 3, 1)).astype(np.uint8)
        return told(r, order, state, least_v[of_v], least_p[of_p])

    def fold(t: pa.Table) -> pa.Table:
        _, v, p, doc, _, _, at, _, _ = in_order(t)
        v, p, doc, team = v[at], p[at], np.minimum.reduceat(doc, at), t.column("team")[0].as_py()
        return pa.Table.from_pylist([{"bucket": k, "block": team, "trigger": v[x:y].tobytes(), "digest": p[x:y].tobytes(), "doc": doc[x:y].tobytes()} for k, x, y in _cuts(v, buckets)], entries)

    def unfold(t: pa.Table, upper: pa.Table) -> pa.Table:
        r, _, _, doc, order, at_v, at_p, of_v, of_p = in_order(t)
        rows = sorted(upper.to_pylist(), key=lambda x: x["bucket"])
        state = np.frombuffer(b"".join(x["state"] for x in rows), np.uint8)
        gv = np.minimum.reduceat(doc, at_p)
        gp = gv.copy()
        gv[state > 0] = np.frombuffer(b"".join(x["by_trigger"] for x in rows), np.int64)
        gp[state > 0] = np.frombuffer(b"".join(x["by_phrase"] for x in rows), np.int64)
        alone = (np.diff(np.append(at_v, len(doc))) == 1)[of_v]
        return told(r, order, np.where(alone, state[of_p], np.maximum(state[of_p], 1)).astype(np.uint8), gv[of_p], gp[of_p])

    def met(source: DataFrame, name: str) -> DataFrame:
        out = _fan_in(source, n_blocks, meet, fold, unfold, "block bigint, bucket bigint, state binary, by_trigger binary, by_phrase binary", name)
        return out if hasattr(out, "_scratch_path") else materialise(out, name)

    shape = "bucket bigint, block bigint, trigger binary, digest binary, doc binary"
    first = met(bodies.mapInArrow(phrases, shape), "phrases")
    opened = pa.schema([("block", pa.int64()), ("whole", pa.binary()), ("place", pa.binary()), ("count", pa.binary()), ("doc", pa.binary()), ("asks", pa.binary()), ("data", pa.binary())])

    def open_phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return opened.empty_table()
        r = left.select(["block", "ids", "sizes", "data"]).to_pylist()[0]
        b = _Block(r["ids"], r["sizes"], r["data"], size)
        whole, open_, asks = b.judge(right)
        place, count = b.start[open_], b.count[open_]
        data = b.data[ragged_gather(place, count + size - 1)] if len(place) else b.data[:0]
        row = {"block": r["block"], "whole": np.stack((b.start[whole], b.count[whole])).astype(np.int64).tobytes(), "place": place.tobytes(), "count": count.tobytes(), "doc": b.doc[open_].tobytes(), "asks": asks[open_].tobytes(), "data": data.tobytes()}
        out = pa.Table.from_pylist([row], opened)
        del b, data
        release()
        return out

    left = materialise(bodies.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(open_phrases, "block bigint, whole binary, place binary, count binary, doc binary, asks binary, data binary"), "open")
    discard(first)

    def again(r: dict) -> tuple[_Block, np.ndarray, np.ndarray]:
        """The open phrases as texts of their own, parsed with longer triggers; their places, and which ask."""
        place, count, doc = (np.frombuffer(r[k], np.int64) for k in ("place", "count", "doc"))
        b = _Block(doc.tolist(), (count + size - 1).tolist(), r["data"], size, TRIGGERS[1])
        return b, place, np.frombuffer(r["asks"], bool)

    def shorter(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = sent(again(r)[0], r["block"])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, entries)

    second = met(left.mapInArrow(shorter, shape), "shorter-phrases")

    def settle(mine: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
        if not mine.num_rows:
            return schema.empty_table()
        r = mine.to_pylist()[0]
        b, place, asking = again(r)
        whole, open_, asks = b.judge(right)
        asked = asking[b.text] if len(b.text) else np.zeros(0, bool)
        origin = place[b.text] + b.start - b.first[b.text] if len(b.text) else b.start
        whole, asks = whole & asked, asks & asked
        rows = []
        # the dictionary of open phrases and its suffixes
        starts, counts = b.start[open_], b.count[open_]
        length = counts + size - 1
        joined = b.data[ragged_gather(starts, length)] if len(starts) else np.zeros(0, np.uint8)
        places = ragged_gather(np.cumsum(length) - length, counts)
        ask_place = ask_doc = ask_entry = np.zeros(0, np.int64)
        if len(places):
            group = suffix_ranks(joined, size)[places]
            doc = np.repeat(b.doc[open_], counts)
            order = np.lexsort((doc, group))
            new = np.ones(len(order), bool)
            new[1:] = group[order][1:] != group[order][:-1]
            at = order[new]
            total, back = _words.sums(joined), _words.inverse_powers(len(joined))
            x = places[at]
            one = mix64((total[x + size] - total[x]) * back[x])
            two = (mix64((total[x + size // 2] - total[x]) * back[x]) >> np.uint64(32)).astype(np.uint32)
            by_digest = np.argsort(one, kind="stable")
            place_of = np.empty(len(at), np.int64)
            place_of[by_digest] = np.arange(len(at))
            entry = np.empty(len(order), np.int64)
            entry[order] = place_of[np.cumsum(new) - 1]
            one, two, least = one[by_digest], two[by_digest], doc[at][by_digest]
            rows += [{"block": r["block"], "bucket": k, "a": one[i:j].tobytes(), "b": two[i:j].tobytes(), "c": least[i:j].tobytes(), "d": b""} for k, i, j in _cuts(one, buckets)]
            ask = np.repeat(asks[open_], counts)
            ask_place, ask_doc, ask_entry = ragged_gather(origin[open_], counts)[ask], doc[ask], entry[ask]
        known = np.frombuffer(r["whole"], np.int64).reshape(2, -1)
        known = np.concatenate((known, np.stack((origin[whole], b.count[whole])).astype(np.int64)), axis=1)
        rows.append({"block": r["block"], "bucket": -1, "a": known.tobytes(), "b": ask_place.astype(np.int64).tobytes(), "c": ask_doc.tobytes(), "d": ask_entry.tobytes()})
        out = pa.Table.from_pylist(rows, schema)
        del b, joined, places
        release()
        return out

    settled = materialise(left.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(settle, "block bigint, bucket bigint, a binary, b binary, c binary, d binary"), "settled")
    discard(second)
    discard(left)

    def strings(t: pa.Table):
        """The rows; both digests and least id of the distinct strings, sorted; which of them each entry is."""
        r = t.to_pydict()
        one, two, doc = (np.frombuffer(b"".join(r[k]), kind) for k, kind in (("a", np.uint64), ("b", np.uint32), ("c", np.int64)))
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        at = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return r, one[order][at], two[order][at], np.minimum.reduceat(doc[order], at), which

    def least_of(r: dict, least: np.ndarray) -> pa.Table:
        ends = np.cumsum([len(x) // 8 for x in r["a"]]).tolist()
        return pa.table({"block": pa.array(r["block"], pa.int64()), "bucket": pa.array(r["bucket"], pa.int64()), "least": pa.array([least[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        r, _, _, least, which = strings(t)
        return least_of(r, least[which])

    def fold_strings(t: pa.Table) -> pa.Table:
        _, one, two, least, _ = strings(t)
        team = t.column("team")[0].as_py()
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
        return pa.Table.from_pylist([{"block": team, "bucket": k, "a": one[x:y].tobytes(), "b": two[x:y].tobytes(), "c": least[x:y].tobytes(), "d": b""} for k, x, y in _cuts(one, buckets)], schema)

    def unfold_strings(t: pa.Table, upper: pa.Table) -> pa.Table:
        r, _, _, _, which = strings(t)
        return least_of(r, np.frombuffer(b"".join(x["least"] for x in sorted(upper.to_pylist(), key=lambda x: x["bucket"])), np.int64)[which])

    merged = _fan_in(settled.where("bucket >= 0"), n_blocks, merge, fold_strings, unfold_strings, "block bigint, bucket bigint, least binary", "merged")
    answers = merged.withColumns({"a": F.lit(None).cast("binary"), "b": F.lit(None).cast("binary"), "c": F.lit(None).cast("binary"), "d": F.lit(None).cast("binary")})
    answers = materialise(answers.unionByName(settled.where("bucket < 0").withColumn("least", F.lit(None).cast("binary"))), "answers")
    discard(settled, merged)

    return blocks, answers


def _cut(left: pa.Table, right: pa.Table, size: int):
    """id, bytes, bytes removed, edges of the spans, and what is kept, of each document of a block."""
    answer = sorted(right.to_pylist(), key=lambda x: x["bucket"])
    release()
    for r in left.select(["ids", "sizes", "data"]).to_pylist():
        own = answer[0]
        least = np.frombuffer(b"".join(x["least"] for x in answer[1:]), np.int64)
        whole = np.frombuffer(own["a"], np.int64).reshape(2, -1)
        place, doc, entry = (np.frombuffer(own[k], np.int64) for k in "bcd")
        hit = place[least[entry] < doc] if len(place) else place
        data = r["data"]
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, np.concatenate((whole[0], hit)), 1)
        np.add.at(mark, np.concatenate((whole[0] + whole[1], hit + 1)) + size - 1, -1)
        gone = (np.cumsum(mark[:-1]) > 0).astype(np.int8)
        at = 0
        for i, n in zip(r["ids"], r["sizes"], strict=True):
            mine, raw = gone[at : at + n], data[at : at + n]
            at += n
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0])))).tolist()
            kept = b"".join(raw[x:y] for x, y in zip([0, *edges[1::2]], [*edges[::2], n], strict=True)) if edges else raw
            yield i, n, int(mine.sum()), edges, kept


def op8_substring_dedup(spark, sf_dir) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

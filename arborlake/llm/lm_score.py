"""Language-model scores from a weighted backoff automaton.

The model holds smoothed n-grams up to ORDER words: a state is a history, its arcs are the words seen after it, and a failure arc leads to
the shorter history at the cost MU / (c(h) + MU). An arc weighs (c(hw) + MU * P(w | shorter)) / (c(h) + MU); the lowest state has an arc
for every word, (c + 0.5) / (N + 0.5 * (V + 1)). Each state's weights sum to one, with a share for one unknown word.

Texts are taken in blocks. A block asks for the corpus counts of its distinct n-grams and builds the part of the automaton that its
texts can reach, so no worker and no driver holds the whole one, and it has no size limit. One traversal from left to right then
carries a state through each text and adds the weights of the arcs and failure arcs that it takes. After ORDER - 1 words the state doesn't
depend on where the traversal began, so long texts are cut into segments that walk side by side after that many words.

Counts meet in two steps: the n-grams of a section of blocks are folded in buckets, and the folded ones of all sections are added up; the
sums travel back the same way. So an n-gram that stands in every block costs a bucket one entry for each section at most.
Words are told apart by 128 bits, so known words and base scores don't rest on 64-bit digests; longer n-grams are, by 64 bits.

Nulls are empty texts, which have one end token; very long texts are a block of their own. Rows with a null id are scored but not learned
from, and aren't held out. Repeated ids are separate texts. An empty table gives an empty result. Results hold only the columns
listed, so others can't clash.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._common import discard, held_out, materialise, mix64, plan_bytes, ragged_gather, release, slices, table, texts_of
from .substring_dedup import BUCKET_BYTES, LEAST_BUCKETS, _cuts

ORDER = 3
MU = 4.0
BLOCK_BYTES = 2 << 20
#: Text bytes of the blocks that are folded together.
SECTION_BYTES = 1 << 30
#: Words of a text that one step of the traversal takes in turn.
SEGMENT = 64
SECOND_BASE = 0xC2B2AE3D27D4EB4F | 1
START, END = np.uint64(0x517CC1B727220A95), np.uint64(0x2545F4914F6CDD1D)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def tokens(raw: list[bytes], bases: tuple = (_words.BASE,)) -> tuple[list[np.ndarray], np.ndarray]:
    """For each base the digests of a start mark, the words and an end mark of each text, and where each text starts (and the end)."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))).astype(np.int64)
    w = ~BLANK[data]
    start = np.flatnonzero(w & ~np.concatenate(([False], w[:-1])))
    end = np.flatnonzero(w & ~np.concatenate((w[1:], [False]))) + 1
    low = _words.LOWER[data]
    each = np.diff(np.searchsorted(start, begin))
    ptr = np.concatenate(([0], np.cumsum(each + 2)))
    inner = np.ones(ptr[-1], bool)
    inner[ptr[:-1]] = inner[ptr[1:] - 1] = False
    out = []
    for base in bases:
        total = _words.sums(low, base)
        h = np.zeros(ptr[-1], np.uint64)
        h[inner] = mix64((total[end] - total[start]) * _words.inverse_powers(len(data), base)[start]) if len(start) else 0
        h[ptr[:-1]], h[ptr[1:] - 1] = START, END
        out.append(h)
    return out, ptr


def grams(h: np.ndarray, ptr: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1..order the digest of the run of words that ends at each place, 0 where the text has too few words before it."""
    out = [h]
    place = np.arange(len(h)) - np.repeat(ptr[:-1], np.diff(ptr))
    for k in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        g[1:] = mix64(out[-1][:-1] * np.uint64(0xD1342543DE82EF95) + h[1:] + np.uint64(k))
        g[place < k - 1] = 0
        out.append(g)
    return out


def _blocks(df: DataFrame, id_col: str, text_col: str, remainder: int, sections: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(part, "text")]
                whole = pa.array([0, len(raw)], pa.int32())
                one = lambda x: pa.ListArray.from_arrays(whole, x)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([(k * 0x9E3779B1 >> 7) % sections], pa.int64()), one(part.column("id")), one(part.column("held")), one(pa.array(list(map(len, raw)), pa.int64())), pa.array([b"".join(raw)], pa.binary())], ["block", "section", "ids", "held", "sizes", "data"])
                k += 1

    source = df.select(F.col(id_col).alias("id"), held_out(id_col, remainder).alias("held"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("section", T.LongType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    return source.mapInArrow(run, schema)


def _pack(n: np.ndarray) -> bytes:
    """Mostly small counts: how many, a byte each, then those of 255 and more in full."""
    return len(n).to_bytes(4, "little") + np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    m = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, m, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", -1, 4 + m)
    return out


def _planes(g: np.ndarray) -> bytes:
    """Sorted digests by their bytes, all highest ones first: those hardly change, so they compress."""
    return g.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def _distinct(g: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order, a place of each, and the number of each place's digest; told apart by check, too, if given."""
    order = np.argsort(g)  # not a stable sort: any place of a digest stands for it
    if check is not None and len(g):
        tie = g[order][1:] == g[order][:-1]
        if (tie & (check[order][1:] != check[order][:-1])).any():  # two words of one digest
            order = np.lexsort((check, g))
    ordered = g[order]
    new = np.ones(len(g), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if check is not None:
        new[1:] |= check[order][1:] != check[order][:-1]
    number = np.empty(len(g), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], number


class _Places:
    """The n-grams of a block: for each length the digest that ends at each place, which places have one, and the distinct ones."""

    def __init__(self, r: dict, order: int, levels):
        ends = np.cumsum(r["sizes"]).tolist()
        raw = [r["data"][a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        (h, *check), self.ptr = tokens(raw, (_words.BASE, SECOND_BASE) if 0 in levels else (_words.BASE,))
        self.mark = np.zeros(len(h), bool)
        self.mark[self.ptr[:-1]] = True
        held = np.array([x is False for x in r["held"]], bool)
        self.learned = np.repeat(held, np.diff(self.ptr)) if len(h) else self.mark
        self.use, self.distinct, self.first, self.number, self.check = {}, {}, {}, {}, {}
        for k, g in enumerate(grams(h, self.ptr, order)):
            if k in levels:
                self.use[k] = np.flatnonzero(~self.mark if k == 0 else g != 0)
                of = check[0][self.use[k]] if k == 0 else None
                self.distinct[k], first, self.number[k] = _distinct(g[self.use[k]], of)
                self.first[k] = self.use[k][first]
                self.check[k] = of[first] if k == 0 else None


def _counts(blocks: DataFrame, order: int, levels: tuple, buckets: int) -> DataFrame:
    """(level, bucket, block, n, total, kinds): the corpus counts of the distinct n-grams of each block, in their order."""

    def send(batches):
        schema = pa.schema([("section", pa.int64()), ("level", pa.int64()), ("bucket", pa.int64()), ("block", pa.int64()), ("gram", pa.binary()), ("check", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            for at in range(batch.num_rows):  # one block at a time: a batch may hold many
                r = batch.slice(at, 1).to_pylist()[0]
                p = _Places(r, order, levels)
                for k in levels:
                    n = np.bincount(p.number[k][p.learned[p.use[k]]], minlength=len(p.distinct[k]))
                    g, check = p.distinct[k], p.check[k]
                    rows = [{"section": r["section"], "level": k, "bucket": b, "block": r["block"], "gram": _planes(g[x:y]), "check": b"" if check is None else check[x:y].tobytes(), "n": _pack(n[x:y])} for b, x, y in _cuts(g, buckets)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                del r, p, rows

    def together(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Columns; first entry of each distinct n-gram, its number for each entry, its count, all checks, and where rows of the table end."""
        r = t.to_pydict()
        g = np.concatenate([_whole(x) for x in r["gram"]])
        check = np.frombuffer(b"".join(r["check"]), np.uint64)
        n = np.concatenate([_unpack(x) for x in r["n"]])
        _, first, number = _distinct(g, check if len(check) else None)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, number, n)
        return r, g, check, first, number, total, np.cumsum([len(x) // 8 for x in r["gram"]]).tolist()

    folded = pa.schema([("section", pa.int64()), ("level", pa.int64()), ("bucket", pa.int64()), ("block", pa.int64()), ("gram", pa.binary()), ("check", pa.binary()), ("n", pa.binary())])

    def fold(t: pa.Table) -> pa.Table:
        r, g, check, first, number, total, ends = together(t)
        one = {"section": r["section"][0], "level": r["level"][0], "bucket": r["bucket"][0]}
        rows = [one | {"block": -1, "gram": _planes(g[first]), "check": check[first].tobytes() if len(check) else b"", "n": _pack(total)}]
        for block, a, b in zip(r["block"], [0, *ends[:-1]], ends, strict=True):  # numbers rise inside a block
            rows.append(one | {"block": block, "gram": b"", "check": b"", "n": _pack(np.diff(number[a:b], prepend=0))})
        return pa.Table.from_pylist(rows, folded)

    def add(t: pa.Table) -> pa.Table:
        r, _, _, _, number, total, ends = together(t)
        m = t.num_rows
        return pa.table({"section": pa.array(r["section"], pa.int64()), "level": pa.array(r["level"], pa.int64()), "bucket": pa.array(r["bucket"], pa.int64()), "n": pa.array([_pack(total[number[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()),
                         "total": [int(total.sum())] + [0] * (m - 1), "kinds": [int((total > 0).sum())] + [0] * (m - 1)})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        total = _unpack(right.column("n")[0].as_py())
        n = [_pack(total[np.cumsum(_unpack(x))]) for x in left.column("n").to_pylist()]
        of = right.to_pydict()
        rows = pa.table({"level": left.column("level"), "bucket": left.column("bucket"), "block": left.column("block"), "n": pa.array(n, pa.binary())})
        return rows.append_column("total", pa.array(of["total"] + [0] * (len(n) - 1))).append_column("kinds", pa.array(of["kinds"] + [0] * (len(n) - 1)))

    shape = "section bigint, level bigint, bucket bigint, block bigint, gram binary, check binary, n binary"
    sent = blocks.select("block", "section", "held", "sizes", "data").mapInArrow(send, shape)
    local = materialise(sent.groupBy("section", "level", "bucket").applyInArrow(fold, shape), "lm-sections")
    added = materialise(local.where("block < 0").groupBy("level", "bucket").applyInArrow(add, "section bigint, level bigint, bucket bigint, n binary, total bigint, kinds bigint"), "lm-totals")
    by = ("section", "level", "bucket")
    out = local.where("block >= 0").select(*by, "block", "n").groupBy(*by).cogroup(added.groupBy(*by)).applyInArrow(answer, "level bigint, bucket bigint, block bigint, n binary, total bigint, kinds bigint")
    out = materialise(out, "lm-counts")
    discard(local, added)
    return out


class Reachable:
    """The states and arcs that the texts of a block can reach. n: for each length the corpus counts of the block's distinct n-grams.

    A state of d words at one place and the word at the next are an arc if the n-gram of d + 1 words that ends there is seen, so arcs are
    found by place and d, without a search."""

    def __init__(self, p: _Places, order: int, n: list[np.ndarray], texts: int, floor: float, mu: float):
        size = len(p.mark)
        fail, fail_weight, depth = [np.zeros(1, np.int32)], [np.zeros(1)], [np.zeros(1, np.int8)]
        weight, target = [], []
        self.arc = np.full((order, size), -1, np.int32)
        states = arcs = 0
        shorter = np.zeros(size, np.int32)  # of each place: the state of its longest seen history of fewer words
        before = lower = None  # counts and chances of the n-grams one word shorter
        for k in range(order):
            use, number, seen = p.use[k], p.number[k], n[k] > 0
            count = np.zeros(size, np.int64)
            count[use] = n[k][number]
            if k == 0:
                count[p.mark] = texts
                chance = (count + 0.5) / floor
                known = np.ones(len(seen), bool)  # the lowest state has an arc for every word
            else:
                history = np.concatenate(([0], before[:-1]))
                chance = (count + mu * lower) / (history + mu)
                known = seen
            at = p.first[k][known]
            number_of = np.full(len(seen), -1, np.int32)
            number_of[known] = arcs + np.arange(len(at), dtype=np.int32)
            self.arc[k, use] = number_of[number]
            arcs += len(at)
            weight.append(np.log10(chance[at]))
            if k < order - 1:  # histories have fewer than ORDER words
                own = np.zeros(len(seen), np.int32)
                own[seen] = states + 1 + np.arange(seen.sum(), dtype=np.int32)
                new = p.first[k][seen]
                fail.append(shorter[new])
                fail_weight.append(np.log10(mu / (n[k][seen] + mu)))
                depth.append(np.full(len(new), k + 1, np.int8))
                states += len(new)
                state = shorter.copy()
                state[use] = np.where(seen[number], own[number], shorter[use])
                if k == 0 and texts:
                    states += 1
                    state[p.mark] = states
                    fail.append(np.zeros(1, np.int32))
                    fail_weight.append(np.log10([mu / (texts + mu)]))
                    depth.append(np.ones(1, np.int8))
                shorter = state
            target.append(shorter[at])
            before, lower = count, chance
        self.start = int(shorter[0]) if size and texts and order > 1 else 0
        self.fail, self.fail_weight, self.depth = map(np.concatenate, (fail, fail_weight, depth))
        self.weight, self.target = np.concatenate(weight), np.concatenate(target)

    def walk(self, ptr: np.ndarray, order: int) -> np.ndarray:
        """Summed weights of each text."""
        parts = -(-(np.diff(ptr) - 1) // SEGMENT)  # of its words and end
        text = np.repeat(np.arange(len(parts)), parts)
        nth = ragged_gather(np.zeros(len(parts), np.int64), parts)
        first = ptr[:-1][text] + 1 + nth * SEGMENT
        stop = np.minimum(first + SEGMENT, ptr[1:][text])
        state = np.where(nth == 0, self.start, 0).astype(np.int32)
        at = np.where(nth == 0, first, first - (order - 1))
        out = np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            s, place, gain = state[live], at[live], np.zeros(len(live))
            todo = np.arange(len(live))
            while len(todo):
                arc = self.arc[self.depth[s[todo]], place[todo]]
                hit = arc >= 0
                done, arc = todo[hit], arc[hit]
                gain[done] += self.weight[arc]
                s[done] = self.target[arc]
                todo = todo[~hit]  # by the failure arc to the shorter history
                gain[todo] += self.fail_weight[s[todo]]
                s[todo] = self.fail[s[todo]]
            state[live] = s
            out[live] += np.where(place >= first[live], gain, 0.0)
            at[live] += 1
            live = live[place + 1 < stop[live]]
        return np.bincount(text, weights=out, minlength=len(parts))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, held_remainder: int = 1, mu: float = MU) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows whose crc32 of the id, modulo 5, is
    held_remainder are not learned from."""
    size = plan_bytes(df.select(id_col, text_col), text_col)
    buckets, sections = max(LEAST_BUCKETS, min(size, SECTION_BYTES) // BUCKET_BYTES), -(-size // SECTION_BYTES) or 1
    blocks = materialise(_blocks(df, id_col, text_col, held_remainder, int(sections)), "lm-blocks")
    # each length in a pass of its own, so that the n-grams of one are on the way at once
    counts = [_counts(blocks, k + 1, (k,), int(buckets)) for k in range(order)]
    counts = reduce(DataFrame.unionByName, counts)
    total, kinds = counts.where("level = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    trained = df.where(~held_out(id_col, held_remainder)).count()
    floor = total + 0.5 * (kinds + 1)

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("ids").type.value_type
        schema = pa.schema([(id_col, kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        answers = sorted(right.select(["level", "bucket", "n"]).to_pylist(), key=lambda x: (x["level"], x["bucket"]))
        n = [np.concatenate([_unpack(x["n"]) for x in answers if x["level"] == k] or [np.zeros(0, np.int64)]) for k in range(order)]
        out = []
        for r in left.drop_columns(["ids"]).to_pylist():
            p = _Places(r, order, range(order))
            known, base = np.zeros(len(p.mark), np.int64), np.zeros(len(p.mark))
            known[p.use[0]] = (n[0] > 0)[p.number[0]]
            base[p.use[0]] = np.log10((n[0] + 0.5) / floor)[p.number[0]]
            sums = [np.add.reduceat(x, p.ptr[:-1]) for x in (known, base)]
            best = Reachable(p, order, n, trained, floor, mu).walk(p.ptr, order)
            ids = left.column("ids").combine_chunks().flatten()
            out.append(pa.table([ids, pa.array([bool(x) for x in r["held"]]), pa.array(np.diff(p.ptr) - 1), pa.array(sums[0]), pa.array(np.full(len(best), total, np.int64)), pa.array(sums[1]), pa.array(best)], schema=schema))
            del p
        release()
        return pa.concat_tables(out) if out else schema.empty_table()

    shape = [df.schema[id_col], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    return blocks.drop("section").groupBy("block").cogroup(counts.select("block", "level", "bucket", "n").groupBy("block")).applyInArrow(weigh, T.StructType(shape))


class BackoffAutomaton:
    """The same model over a few texts, as states with arcs and failure arcs: the plain form that :func:`score` is held against."""

    def __init__(self, texts: list[str], order: int = ORDER, mu: float = MU):
        self.order, self.mu = order, mu
        self.counts: dict[tuple, int] = {}
        self.total, self.texts = 0, len(texts)
        for t in texts:
            words = self.words(t)
            self.total += len(words)
            padded = [None, *words]
            for i in range(1, len(padded)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        key = tuple(padded[i - k + 1 : i + 1])
                        self.counts[key] = self.counts.get(key, 0) + 1
        self.floor = self.total + 0.5 * (sum(1 for k in self.counts if len(k) == 1) + 1)

    @staticmethod
    def words(text: str) -> list:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        return [*raw.split(), ""]

    def weight(self, state: tuple, word) -> float:
        """Weight of the arc, or of the failure arcs down to a state that has it."""
        if not state:
            return (self.counts.get((word,), 0) + 0.5) / self.floor
        seen = self.texts if state == (None,) else self.counts.get(state, 0)
        return (self.counts.get((*state, word), 0) + self.mu * self.weight(state[1:], word)) / (seen + self.mu)

    def score(self, text: str) -> float:
        state, out = (None,) if self.order > 1 else (), 0.0
        for w in self.words(text):
            out += math.log10(self.weight(state, w))
            state = (*state, w)[-(self.order - 1) :] if self.order > 1 else ()
        return out


def op9_lm_score(spark, sf_dir) -> DataFrame:
    got = score(table(spark, sf_dir, "documents"))
    return got.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # sums of many logarithms, to what doesn't depend on their order

"""Benchmark decontamination by templates.

Words are made canonical: those with a digit and number words become a number slot, measuring units a unit slot, and capitalised words a
name slot. A run of capitalised words is one slot, and so is a number with separators. Each text is read three times: words that open
sentences are plain, or may be names, or no word is a name (texts in capitals or small letters). Windows of WINDOW canonical words of
each benchmark item (of all its words, if it has fewer) are hashed. Hits of one item that lie on one line (the same distance
between both places) are an alignment, and so is a chain of such lines. It counts when it has COVERAGE of the item's windows, and
when each slot value of the item always stands for one value of the document. So exact copies and questions with other numbers, names
or units are found. Besides, a run of RUN words of an item counts as it stands, whatever share of the item it is, and so
does the whole of a shorter item that has no windows; a run that several items share is reported for the least of them.

Windows meet in a hash join:

1. An item needs COVERAGE of its windows, so a document that has them has one of any 1 - COVERAGE of them and one more. The rarest
   windows of each item, by their count in the benchmark, are its keys; windows that many items share hardly ever are.
2. A Bloom filter of the keys, of at most FILTER_BITS whatever the benchmark's size, goes to the tasks that read the documents. They
   pass on texts with a window in it, once for equal texts.
3. Their digests in the filter are joined with the keys, in SALTS shares, as a passage may stand in a third of all documents.
4. Texts that have keys, and the items of these, meet in buckets of about BUCKET_BYTES, and are aligned.

Nulls are empty texts; items without words match nothing; windows with fewer than LITERALS plain words are not used, or fewer than
LITERALS + 1 if the item is shorter than a window. Very long texts are read whole. Rows with a null id are judged like others and repeated ids
each on their own; equal texts get equal verdicts; ties of items are all reported. Items with a null id are left out, repeated items are one.
Empty tables: no document is contaminated. Results hold only the columns listed, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._common import discard, materialise, mix64, ragged_gather, slices, table, texts_of

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
#: Words of an item that count wherever they stand in a row.
RUN = 24
#: Bits of the filter at most; at least 64 for each key until then, so about one digest in 10^5 passes by chance.
FILTER_BITS = 1 << 29
PROBES = 4
SALTS = 16
#: Candidate text in a bucket.
BUCKET_BYTES = 8 << 20
#: English number words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = "km m cm mm miles mile feet foot inches inch yards yard kg g mg pounds pound ounces ounce tons litres liters litre liter ml gallons gallon hours hour minutes minute seconds second days day weeks week months month years year dollars dollar cents cent euros euro percent degrees degree mph kmh".split()
NUMBER, NAME, UNIT = np.uint64(0xA5A5A5A5A5A5A501), np.uint64(0xA5A5A5A5A5A5A502), np.uint64(0xA5A5A5A5A5A5A503)


#: Bytes between words of one name, and between parts of one number.
NAME_GAP, NUMBER_GAP = np.zeros(256, bool), np.zeros(256, bool)
NAME_GAP[[ord(c) for c in " \t\r\n-'"]] = True
NUMBER_GAP[[ord(c) for c in ".,:/'"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True
READINGS = 3  # words that open sentences are plain, or may be names, or no word is a name
VERBATIM = READINGS  # rows of whole items and runs, as they stand


@dataclass
class Tokens:
    text: np.ndarray
    hash: np.ndarray  # canonical: all slots of a kind are the same
    value: np.ndarray
    slot: np.ndarray
    judged: np.ndarray  # slots, and names where no word is read as one


def readings(w: _words.Words) -> list[Tokens]:
    n = len(w.hash)
    digits = np.concatenate(([0], np.cumsum((w.data >= 48) & (w.data <= 57))))
    breaks = np.concatenate(([0], np.cumsum(_words.BREAK[w.data])))
    strange = np.concatenate(([0], np.cumsum(~NAME_GAP[w.data])))
    figure = digits[w.end] > digits[w.start]
    number = figure | np.isin(w.hash, _words.words(NUMBER_WORDS).hash)
    unit = np.isin(w.hash, _words.words(UNITS).hash) & ~number
    head = w.data[w.start]
    second = w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    capital &= ~number & ~unit
    same = np.zeros(n, bool)
    opening = np.ones(n, bool)
    of_number, of_name = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        left, right = w.end[:-1], w.start[1:]
        same[1:] = w.text[1:] == w.text[:-1]
        opening[1:] = ~same[1:] | (breaks[right] > breaks[left])
        digit = lambda at: (w.data[at] >= 48) & (w.data[at] <= 57)
        of_number[1:] = same[1:] & figure[1:] & figure[:-1] & (right - left == 1) & NUMBER_GAP[w.data[left]] & digit(left - 1) & digit(right)
        of_name[1:] = same[1:] & (strange[right] == strange[left])
    out = []
    for name in (capital & ~opening, capital, np.zeros(n, bool)):
        joined = of_number.copy()
        joined[1:] |= of_name[1:] & name[1:] & name[:-1]
        at = np.flatnonzero(~joined)
        h = w.hash.copy()
        h[number], h[unit], h[name] = NUMBER, UNIT, NAME
        rank = np.arange(n) - at[np.cumsum(~joined) - 1] if n else np.zeros(0, np.int64)
        value = np.add.reduceat(w.hash * _words.powers(n)[rank], at) if n else w.hash
        slot = (number | unit | name)[at]
        out.append(Tokens(w.text[at], h[at], value, slot, slot | (capital & ~opening)[at]))
    return out


def windows(t: Tokens, reading: int, size: int = WINDOW, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first token, and digest, of each window inside a text with enough plain words."""
    n = len(t.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    base = _words.powers(size)
    for j in range(size):
        g += t.hash[j : j + n] * base[j + 1]
    slots = np.concatenate(([0], np.cumsum(t.slot)))
    at = np.flatnonzero((t.text[:n] == t.text[size - 1 : size - 1 + n]) & (slots[size:] - slots[:-size] <= size - literals))
    return at, mix64(g[at] ^ np.uint64(reading))


def runs(w: _words.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word, and digest, of each run of so many words of a text, slots or not."""
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.text[:n] == w.text[length - 1 : length - 1 + n])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * _words.powers(len(w.hash))[: len(w.hash)], dtype=np.uint64)))
    return at, mix64((total[at + length] - total[at]) * _words.inverse_powers(len(w.hash))[at] ^ np.uint64(VERBATIM + length))


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows for each item: for each reading with windows, their digests (grams), places and words (size), value of each token (words) and which
    are judged; and digests of its runs of RUN words, or of the whole item if it is shorter and has no windows (reading VERBATIM, size:
    words of a run)."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(id_col).to_pylist(), texts_of(batch, text_col), strict=True):
                w = _words.words([text])
                usable = False
                for reading, t in enumerate(readings(w)):
                    own = min(size, len(t.hash))
                    at, g = windows(t, reading, own, LITERALS + (own < size))
                    if len(at):
                        usable = True
                        rows.append({"item": item, "reading": reading, "size": own, "grams": g.tobytes(), "places": at.astype(np.int64).tobytes(), "words": t.value.tobytes(), "slots": t.judged.tobytes(), "n": len(at)})
                length = RUN if len(w.hash) >= RUN else 0 if usable else len(w.hash)
                if length:
                    g = np.unique(runs(w, length)[1])
                    rows.append({"item": item, "reading": VERBATIM, "size": length, "grams": g.tobytes(), "places": b"", "words": b"", "slots": b"", "n": len(g)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.int64()), ("reading", pa.int32()), ("size", pa.int32()), ("grams", pa.binary()), ("places", pa.binary()), ("words", pa.binary()), ("slots", pa.binary()), ("n", pa.int64())]))

    items = bench.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).distinct()
    return items.mapInArrow(run, "item bigint, reading int, size int, grams binary, places binary, words binary, slots binary, n bigint")


def _keys(rows: DataFrame, coverage: float) -> DataFrame:
    """(gram, item, verbatim): the rarest windows of each item and reading, one of which any document with enough of them has; all runs."""

    def flat(batches):
        for batch in batches:
            for item, reading, grams, n in zip(*(batch.column(c).to_pylist() for c in ("item", "reading", "grams", "n")), strict=True):
                g, places = np.unique(np.frombuffer(grams, np.uint64), return_counts=True)
                spare = n - int(np.ceil(coverage * n)) if reading != VERBATIM else n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), item)), pa.array(np.full(len(g), reading, np.int32)), pa.array(g.view(np.int64)), pa.array(places), pa.array(np.full(len(g), spare))], ["item", "reading", "gram", "places", "spare"])

    every = rows.select("item", "reading", "grams", "n").mapInArrow(flat, "item bigint, reading int, gram bigint, places bigint, spare bigint")
    every = materialise(every.groupBy("item", "reading", "gram").agg(F.max("places").alias("places"), F.max("spare").alias("spare")), "windows")
    kept = every.where(F.col("reading") != VERBATIM)
    kept = kept.join(kept.groupBy("gram").agg(F.count("*").alias("items")), "gram")
    before = F.sum("places").over(Window.partitionBy("item", "reading").orderBy("items", "gram").rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= spare").select("gram", "item", F.lit(False).alias("verbatim")).distinct()
    run = every.where(F.col("reading") == VERBATIM).groupBy("gram").agg(F.min("item").alias("item")).select("gram", "item", F.lit(True).alias("verbatim"))
    out = materialise(kept.unionByName(run), "keys")
    discard(every)
    return out


class _Filter:
    """A Bloom filter with PROBES places for each digest."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def place(g: np.ndarray, probe: int, bits: int) -> np.ndarray:
        return (mix64(g ^ np.uint64(probe * 0x9E3779B97F4A7C15 % (1 << 64))) if probe else g) & np.uint64(bits - 1)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = np.arange(len(g))
        for probe in range(PROBES):
            bit = self.place(g[at], probe, len(self.words) * 64)
            at = at[(self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        return at


def _filter(keys: DataFrame) -> _Filter:
    """Built in chunks by the tasks that hold the keys; the driver gets FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << int(64 * keys.count()).bit_length()))
    chunk = 1 << 16

    def run(batches):
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            for probe in range(PROBES):
                at = _Filter.place(np.asarray(batch.column("gram")).view(np.uint64), probe, bits)
                for k in np.unique(at // np.uint64(chunk)).tolist():
                    inside = at[at // np.uint64(chunk) == k] % np.uint64(chunk)
                    np.bitwise_or.at(mine.setdefault(k, np.zeros(chunk // 64, np.uint64)), (inside >> np.uint64(6)).astype(np.int64), np.uint64(1) << (inside & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int64()), pa.array([x.tobytes() for x in mine.values()], pa.binary())], ["chunk", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        one = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]), axis=0)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "bits": pa.array([one.tobytes()], pa.binary())})

    words = np.zeros(bits // 64, np.uint64)
    for r in keys.select("gram").mapInArrow(run, "chunk bigint, bits binary").groupBy("chunk").applyInArrow(merge, "chunk bigint, bits binary").toLocalIterator():
        words[r.chunk * (chunk // 64) : (r.chunk + 1) * (chunk // 64)] = np.frombuffer(bytes(r.bits), np.uint64)
    return _Filter(words)


class _Part:
    """Windows of some items."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["item"], r["reading"], r["words"]))
        self.items = [r["item"] for r in rows]
        self.words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.slots = [np.frombuffer(r["slots"], bool) for r in rows]
        self.count = np.array([r["n"] for r in rows], np.int64)
        self.size = np.array([r["size"] for r in rows], np.int64)
        gram = np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), self.count)
        place = np.concatenate([np.frombuffer(r["places"], np.int64) for r in rows]) if rows else owner
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.place = gram[order], owner[order], place[order]

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of a digest asked for and an entry with it."""
        lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
        return np.repeat(np.arange(len(g)), hi - lo), ragged_gather(lo, hi - lo)


def _consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Does each slot value of the item (a) always stand for one value of the document (b)?"""
    pairs = len(np.unique(np.stack((a, b)), axis=1).T) if len(a) else 0
    return pairs == len(np.unique(a))


def _lines(doc: np.ndarray, item: np.ndarray, size: int, most: int, need: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alignments with at least so many hits, as places in document and item: first those of one distance between both, then chains of
    runs of hits of different distances, in the order of both and no further apart than the item is long."""
    order = np.lexsort((doc, doc - item))
    doc, item = doc[order], item[order]
    shift = doc - item
    edge = np.flatnonzero(np.diff(shift)) + 1
    for d, i in zip(np.split(doc, edge), np.split(item, edge), strict=True):
        if len(d) >= need:
            yield d, i
    if not len(edge):
        return
    edge = np.flatnonzero((np.diff(shift) != 0) | (np.diff(doc) > size)) + 1
    pieces = sorted(zip(np.split(doc, edge), np.split(item, edge), strict=True), key=lambda x: int(x[0][0]))
    p0, p1 = np.array([x[0][0] for x in pieces]), np.array([x[0][-1] for x in pieces])
    q0, q1 = np.array([x[1][0] for x in pieces]), np.array([x[1][-1] for x in pieces])
    score, before = np.array([float(len(x[0])) for x in pieces]), np.full(len(pieces), -1)
    for k in range(len(pieces)):
        lo = int(np.searchsorted(p0, p0[k] - 3 * most))
        moved = np.abs((p0[k] - q0[k]) - (p1[lo:k] - q1[lo:k]))
        ok = (p1[lo:k] < p0[k]) & (q1[lo:k] < q0[k]) & (moved <= most)
        if ok.any():
            gain = np.where(ok, score[lo:k] - 1e-4 * moved / most, -1)
            best = int(np.argmax(gain))
            score[k] += gain[best]
            before[k] = lo + best
    for k in np.argsort(-score, kind="stable").tolist():
        if score[k] < need - 0.5:
            return
        chain, j = [], k
        while j >= 0:
            chain.append(pieces[j])
            j = before[j]
        d, i = (np.concatenate([x[z] for x in chain[::-1]]) for z in (0, 1))
        if len(chain) > 1 and len(d) >= need:
            yield d, i


def _aligned(here: np.ndarray, there: np.ndarray, words: np.ndarray, slots: np.ndarray, value: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Also the tokens next to both ends, as far as the plain words go on alike."""
    for step, p, q in ((-1, int(here[0]), int(there[0])), (1, int(here[-1]), int(there[-1]))):
        last, k = 0, 1
        while lo <= p + step * k < hi and 0 <= q + step * k < len(words):
            if not slots[q + step * k]:
                if words[q + step * k] != value[p + step * k]:
                    break
                last = k
            k += 1
        more = step * np.arange(1, last + 1)
        here, there = np.concatenate((here, p + more)), np.concatenate((there, q + more))
    return here, there


def _digests(texts: list[str], sizes: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Text and digest of all windows of all readings, and of all runs."""
    w = _words.words(texts)
    text, gram = [], []
    for length in lengths:
        at, g = runs(w, length)
        text.append(w.text[at])
        gram.append(g)
    for reading, t in enumerate(readings(w)):
        for size in sizes:
            at, g = windows(t, reading, size, 1)
            text.append(t.text[at])
            gram.append(g)
    return (np.concatenate(text), np.concatenate(gram)) if text else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _matches(part: _Part, texts: list[str], coverage: float) -> list[list[tuple]]:
    """For each text (item, share of the item's windows, verbatim) of each item found."""
    w = _words.words(texts)
    best: dict[tuple, tuple] = {}

    def keep(text: int, row: tuple) -> None:
        old = best.get((text, row[0]))
        if old is None or old[1:] < row[1:]:
            best[text, row[0]] = row

    for reading, t in enumerate(readings(w)):
        for size in np.unique(part.size).tolist():
            at, g = windows(t, reading, size, 1)
            k, j = part.hits(g)
            own = part.size[part.owner[j]] == size
            k, j = k[own], j[own]
            text, owner = t.text[at[k]], part.owner[j]
            order = np.lexsort((owner, text))
            text, owner, doc, item = text[order], owner[order], at[k[order]], part.place[j[order]]
            cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(owner) != 0)) + 1
            cut = np.concatenate(([0], cut, [len(text)])) if len(text) else np.zeros(1, np.int64)
            enough = np.flatnonzero(np.diff(cut) >= coverage * part.count[owner[cut[:-1]]]) if len(text) else []
            for c in enough:
                one = slice(cut[c], cut[c + 1])
                x, o = int(text[cut[c]]), int(owner[cut[c]])
                need = coverage * part.count[o]
                if len(np.unique(item[one])) < need:
                    continue
                words, slots = part.words[o], part.slots[o]
                lo, hi = np.searchsorted(t.text, [x, x + 1])
                for d, i in _lines(doc[one], item[one], size, len(words), need):
                    both = np.unique(np.stack((np.add.outer(d, np.arange(size)).ravel(), np.add.outer(i, np.arange(size)).ravel())), axis=1)
                    here, there = both[0], both[1]
                    verbatim = bool((words[there] == t.value[here]).all()) and len(np.unique(d - i)) == 1
                    here, there = _aligned(here, there, words, slots, t.value, lo, hi)
                    s = slots[there]
                    if _consistent(words[there][s], t.value[here][s]):
                        keep(x, (part.items[o], len(d) / part.count[o], verbatim))
                        if len(d) == part.count[o]:
                            break
    found: list[list[tuple]] = [[] for _ in texts]
    for (text, _), row in sorted(best.items()):
        found[text].append(row)
    return found


def _screened(df: DataFrame, rows: DataFrame, keys: DataFrame, text_col: str, carried: list) -> DataFrame:
    """row (struct of the carried columns), and for texts with a window in the filter: key (digest of the text), text and grams."""
    spark = df.sparkSession
    sizes = sorted(r["size"] for r in rows.where(F.col("reading") != VERBATIM).select("size").distinct().collect())  # WINDOW values at most
    lengths = sorted(r["size"] for r in rows.where(F.col("reading") == VERBATIM).select("size").distinct().collect())  # RUN values at most
    shared = spark.sparkContext.broadcast(_filter(keys).words)

    def run(batches):
        keep = _Filter(shared.value)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                text, gram = _digests(texts_of(piece, "text"), sizes, lengths)
                at = keep(gram)
                text, gram = text[at], gram[at]
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
                text, gram = text[new], gram[new]
                ptr = np.searchsorted(text, np.arange(piece.num_rows + 1)).astype(np.int32)
                none = np.diff(ptr) == 0
                hit = pa.array(np.arange(len(none)), mask=none)
                grams = pa.ListArray.from_arrays(pa.array(ptr), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("row"), *(x.take(hit) for x in (piece.column("key"), piece.column("text"), grams))], ["row", "key", "text", "grams"])

    source = df.select(F.struct(*carried).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    schema = T.StructType([source.schema["row"], T.StructField("key", T.BinaryType()), T.StructField("text", T.StringType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return materialise(source.select("row", "key", "text").mapInArrow(run, schema), "screened")


def _salt(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(F.lit(11), by), F.lit(SALTS)).cast("int"))


def _verdicts(screened: DataFrame, rows: DataFrame, keys: DataFrame, coverage: float) -> DataFrame:
    """(key, item, verbatim) of the texts that hold an item."""
    some = screened.where("key is not null")
    grams = some.select("key", "grams").groupBy("key").agg(F.first("grams").alias("grams"))
    asked = _salt(grams.select("key", F.explode("grams").alias("gram")), "key")
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = materialise(asked.join(spread(keys), ["gram", "salt"]).groupBy("key", "item").agg(F.max("verbatim").alias("verbatim"), F.min("verbatim").alias("run_only")), "pairs")
    to_align = spread(pairs.where("not run_only").select("key").distinct())
    texts = _salt(some.select("row", "key", "text"), "row").join(to_align, ["key", "salt"], "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    aligned = pairs.where("not run_only")
    left = texts.select(bucket, "key", "text")
    right = aligned.select(bucket, "item").distinct().join(rows.where(F.col("reading") != VERBATIM), "item")

    def align(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        part = _Part(b.to_pylist())
        keys_, texts_ = a.column("key").to_pylist(), a.column("text").to_pylist()
        for lo in range(0, len(texts_), 64):
            for key, found in zip(keys_[lo : lo + 64], _matches(part, texts_[lo : lo + 64], coverage), strict=True):
                out += [{"key": key, "item": item, "verbatim": verbatim} for item, _, verbatim in found]
        return pa.Table.from_pylist(out, pa.schema([("key", pa.binary()), ("item", pa.int64()), ("verbatim", pa.bool_())]))

    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(align, "key binary, item bigint, verbatim boolean")
    found = found.unionByName(pairs.where("verbatim").select("key", "item", "verbatim"))
    out = materialise(found.groupBy("key", "item").agg(F.max("verbatim").alias("verbatim")), "found")
    discard(texts, pairs)
    return out


def contamination(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per row: id, contaminated, item_ids (sorted), verbatim_ids (those found word for word)."""
    rows = materialise(benchmark_windows(bench, item_col, item_text, size), "benchmark")
    keys = _keys(rows, coverage)
    screened = _screened(df, rows, keys, text_col, [F.col(id_col)])
    found = _verdicts(screened, rows, keys, coverage)
    discard(rows, keys)
    listed = found.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.array_sort(F.collect_set(F.when(F.col("verbatim"), F.col("item")))).alias("verbatim_ids"))
    # a text in very many documents isn't one key: its answer goes to salted shares
    hit = _salt(screened.where("key is not null").select(F.col("row")[id_col].alias(id_col), "key"), id_col)
    listed = hit.select("key", "salt").distinct().join(listed, "key")
    none = F.array().cast("array<bigint>")
    hit = hit.join(listed, ["key", "salt"], "left").select(id_col, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("verbatim_ids", none).alias("verbatim_ids"))
    return hit.unionByName(screened.where("key is null").select(F.col("row")[id_col].alias(id_col), F.lit(False).alias("contaminated"), none.alias("item_ids"), none.alias("verbatim_ids")))


def keep_clean(df: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``df``, with all their columns, in which no item is found."""
    rows = materialise(benchmark_windows(bench, item_col, item_text, size), "benchmark")
    keys = _keys(rows, coverage)
    screened = _screened(df, rows, keys, text_col, [F.col(f"`{c}`") for c in df.columns])
    found = _verdicts(screened, rows, keys, coverage).select("key").distinct()
    discard(rows, keys)
    hit = screened.where("key is not null").select("row", "key").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    clean = hit.join(found, ["key", "salt"], "left_anti").select("row.*").unionByName(screened.where("key is null").select("row.*"))
    return clean.select([f"`{c}`" for c in df.columns])


def op3_decontaminate(spark, sf_dir) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Toxicity by a weighted finite-state grammar.

Words become symbols: insult, threat, target, negation, report, other. Six transducers read a clause: negation and reported
speech rewrite insults and threats in their reach to weaker symbols; the target transducer strengthens those after a target, and the
landing transducer marks a target that an insult or a threat reaches ("kill you"); the insult and threat transducers weigh what is
left. They are composed into one table that is run over each clause, so a word counts by the clause it stands in. A text's
score is a logistic function of its clauses' weights.

Learned from at most about SAMPLE labelled rows whose crc32 of the id, modulo 5, isn't 0: the insult lexicon (word stems), the
weight of each symbol (a logistic fit on how often each is written, drawn towards PRIOR, which stands where no row says otherwise) and the
logistic function. Near copies count once there (rows with one least shingle: the least text), and only texts are looked at. The words
of threats, targets, negations and reports are fixed lists.

Null and empty texts have no clause and get the lowest score; very long texts and clauses are read whole. Rows with a null id are scored and
not held out; repeated ids are scored each; of different labels of one id the greater counts. Rows with a null label aren't learned from;
with no usable labels a small general lexicon is used. An empty table gives an empty result. Results hold only the columns
listed, so others can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, held_out, materialise, slices, table, texts_of
from ._words import shingles, words

SAMPLE = 20_000
SUPPORT, LIFT = 0.01, 20.0
SHORTEST, LONGEST = 3, 8
REACH = 3

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, WEAK_INSULT, WEAK_THREAT, AIMED_INSULT, AIMED_THREAT, LANDED_INSULT, LANDED_THREAT = range(12)
SYMBOLS = 12
#: Weights of the symbols before anything is learned, and what a weight of 1 means to the logistic fit.
PRIOR = {INSULT: 1.0, WEAK_INSULT: 0.15, AIMED_INSULT: 1.3, LANDED_INSULT: 0.3, THREAT: 0.15, WEAK_THREAT: 0.03, AIMED_THREAT: 1.0, LANDED_THREAT: 0.9}
SCALE = 4.0
WORDS = {
    THREAT: "kill killing hurt hurting destroy destroying stab stabbing shoot shooting burn burning punch crush beat strangle murder töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours he him his she her they them their du dich dir ihr euch sie tu te toi vous ils elles usted tú ellos ellas",
    NEGATION: "not no never nobody nothing neither without nicht kein keine nie niemals ne pas jamais nunca tampoco sin",
    REPORT: "said says say called calls claimed claims wrote quoted quotes alleged sagte sagt nannte dit disait écrit dijo dice llamó",
}
GENERAL = "idiot moron stupid worthless pathetic scum disgusting".split()
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"\w+")


class Transducer:
    """A deterministic transducer: step[state][symbol] = (next state, symbol written, (insult weight, threat weight))."""

    def __init__(self, step: list[list[tuple]]):
        self.step = step

    @classmethod
    def identity(cls, states: int = 1) -> Transducer:
        return cls([[(q, s, (0.0, 0.0)) for s in range(SYMBOLS)] for q in range(states)])

    def compose(self, other: Transducer) -> Transducer:
        """self, then other on what it writes."""
        index, todo, step = {(0, 0): 0}, [(0, 0)], []
        while todo:
            p, q = todo.pop(0)
            row = []
            for s in range(SYMBOLS):
                p2, mid, (a, b) = self.step[p][s]
                q2, out, (c, d) = other.step[q][mid]
                if (p2, q2) not in index:
                    index[p2, q2] = len(index)
                    todo.append((p2, q2))
                row.append((index[p2, q2], out, (a + c, b + d)))
            step.append(row)
        return Transducer(step)

    def write(self, symbols: list[int]) -> list[int]:
        q, out = 0, []
        for s in symbols:
            q, mid, _ = self.step[q][s]
            out.append(mid)
        return out

    def weigh(self, symbols: list[int]) -> tuple[float, float]:
        q, a, b = 0, 0.0, 0.0
        for s in symbols:
            q, _, (x, y) = self.step[q][s]
            a, b = a + x, b + y
        return a, b


def _reach(opener: int, rewrite: dict[int, int], steps: int) -> Transducer:
    """For some steps after the opener, symbols are rewritten."""
    t = Transducer.identity(steps + 1)
    for q in range(steps + 1):
        for s in range(SYMBOLS):
            to = steps if s == opener else max(0, q - 1)
            t.step[q][s] = (to, rewrite.get(s, s) if q else s, (0.0, 0.0))
    return t


def _weights(by: dict[int, tuple[float, float]]) -> Transducer:
    t = Transducer.identity()
    for s, w in by.items():
        t.step[0][s] = (0, s, w)
    return t


def _landing(steps: int) -> Transducer:
    """A target that comes some steps after an insult or a threat (weakened and aimed ones aside) is written as where it lands."""
    t = Transducer.identity(2 * steps + 1)  # 0; 1..steps: an insult so near; steps + 1..: a threat
    for q in range(2 * steps + 1):
        kind, left = (LANDED_INSULT, q) if q <= steps else (LANDED_THREAT, q - steps)
        base = 0 if q <= steps else steps
        for s in range(SYMBOLS):
            to = steps if s == INSULT else 2 * steps if s == THREAT else base + left - 1 if left > 1 else 0
            if q and s == TARGET:
                t.step[q][s] = (0, kind, (0.0, 0.0))
            else:
                t.step[q][s] = (to, s, (0.0, 0.0))
    return t


def transducers(weights: dict[int, float] = PRIOR) -> list[Transducer]:
    weak = {INSULT: WEAK_INSULT, THREAT: WEAK_THREAT}
    of = lambda *symbols: {s: weights[s] for s in symbols}
    return [
        _reach(NEGATION, weak, REACH),
        _reach(REPORT, weak, 2 * REACH),
        _reach(TARGET, {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}, REACH),
        _landing(REACH),
        _weights({s: (w, 0.0) for s, w in of(INSULT, WEAK_INSULT, AIMED_INSULT, LANDED_INSULT).items()}),
        _weights({s: (0.0, w) for s, w in of(THREAT, WEAK_THREAT, AIMED_THREAT, LANDED_THREAT).items()}),
    ]


def grammar(weights: dict[int, float] = PRIOR) -> Transducer:
    return reduce(Transducer.compose, transducers(weights))


class Scorer:
    """Features of texts: largest weight of a clause, summed insult and threat weights, clauses hit."""

    def __init__(self, stems: list[str], weights: dict[int, float] = PRIOR):
        self.table = grammar(weights)
        self.words = {w: s for s, listed in WORDS.items() for w in listed.split()}
        self.insult = re.compile("|".join(sorted(map(re.escape, stems), key=len, reverse=True))) if stems else None
        threats = WORDS[THREAT].split()
        self.screen = "|".join(re.escape(x) for x in [*stems, *threats])
        self.any = re.compile(self.screen)

    def symbol(self, w: str) -> int:
        if self.insult is not None and self.insult.match(w):
            return INSULT
        return self.words.get(w, OTHER)

    def clauses(self, text: str) -> Iterator[list[int]]:
        """Symbols of the clauses that hold an insult or a threat."""
        for clause in CLAUSE.split(text.lower()):
            if self.any.search(clause):
                yield [self.symbol(w) for w in WORD.findall(clause)]

    def text(self, text: str) -> tuple[float, float, float, float]:
        best = total = threat = hit = 0.0
        for symbols in self.clauses(text):
            a, b = self.table.weigh(symbols)
            best, total, threat, hit = max(best, a + b), total + a, threat + b, hit + (a + b > 0)
        return best, np.log1p(total), np.log1p(threat), np.log1p(hit)

    def counts(self, text: str) -> list[float]:
        """How often each weighed symbol is written, as logarithms."""
        got: Counter = Counter()
        for symbols in self.clauses(text):
            got.update(self.table.write(symbols))
        return [float(np.log1p(got[s])) for s in PRIOR]

    def batch(self, column: pa.Array, of=None, width: int = 4) -> np.ndarray:
        column = pc.fill_null(column, "")
        out = np.zeros((len(column), width))
        low = pc.utf8_lower(column)
        for k in np.flatnonzero(np.asarray(pc.match_substring_regex(low, self.screen))).tolist():
            out[k] = (of or self.text)(column[k].as_py())
        return out


def _stems_of(text: str) -> set[str]:
    return {w[:k] for w in set(WORD.findall(text.lower())) if not w[0].isdigit() for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def _counted(sample: DataFrame, allowed: set[str] | None) -> DataFrame:
    def run(batches):
        for batch in batches:
            got: Counter = Counter()
            for t in texts_of(batch, "text"):
                s = _stems_of(t)
                got.update(s if allowed is None else s & allowed)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["stem", "n"])

    return sample.select("text").mapInArrow(run, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n"))


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> DataFrame:
    """id, text, y of about ``limit`` labelled rows to learn from, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, F.col(label).cast("int").alias("y")).groupBy(id_col).agg(F.max("y").alias("y"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(max(1, -(-n // limit)))) == 0)
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), id_col)  # about ``limit`` rows


def learn_stems(sample: DataFrame) -> list[str]:
    """Stems that rows labelled 1 have often and others hardly ever, each grown as far as its rows go along."""
    positive = sample.where("y = 1").count()
    negative = sample.where("y = 0").count()
    if not positive or not negative:
        return list(GENERAL)
    least = max(5, int(SUPPORT * positive))
    pos = {r.stem: r.n for r in _counted(sample.where("y = 1"), None).where(F.col("n") >= least).collect()}  # each row has few such stems
    neg = {r.stem: r.n for r in _counted(sample.where("y = 0"), set(pos)).collect()}
    pure = {s for s, n in pos.items() if n / positive >= LIFT * (neg.get(s, 0) + 0.5) / negative}
    out = set()
    for s in sorted(pure, key=len):
        if any(s[:k] in pure for k in range(SHORTEST, len(s))):
            continue
        while True:
            cleaner = {t for t in pure if neg.get(t, 0) < neg.get(s, 0) and pos[t] >= 0.6 * pos[s]}
            longer = [t for t in pure if len(t) == len(s) + 1 and t.startswith(s) and (t in cleaner or pos[t] >= 0.97 * pos[s])]
            if not longer:
                break
            s = max(longer, key=pos.get)
        out.add(s)
    return sorted(out) or list(GENERAL)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, prior: np.ndarray | None = None) -> np.ndarray:
    """Intercept and weights, drawn towards the prior ones (zeros)."""
    x = np.column_stack((np.ones(len(x)), x))
    prior = np.concatenate(([0.0], np.zeros(x.shape[1] - 1) if prior is None else prior))
    w = prior.copy()
    w[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    pull = ridge * np.append(0, np.ones(len(w) - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (pull * (w - prior) ** 2).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull + 1e-9), x.T @ (p - y) + pull * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, now):
            break
    return w


class Model:
    """Learned stems, symbol weights and logistic weights, of a few hundred bytes."""

    def __init__(self, stems: list[str], weights: np.ndarray, symbols: dict[int, float] = PRIOR):
        self.stems, self.weights, self.symbols = stems, weights, symbols
        self._scorer: Scorer | None = None

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "symbols": self.symbols, "_scorer": None}

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score, and weight of the heaviest clause, of each text."""
        self._scorer = self._scorer or Scorer(self.stems, self.symbols)
        x = self._scorer.batch(column)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))), x[:, 0]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    def family(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, t = shingles(words(texts_of(part, "text")), 5)
                least = np.full(part.num_rows, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, t, h)
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("y"), pa.array(least.view(np.int64))], ["text", "y", "family"])

    sample = labelled_sample(df, labels, label, id_col, text_col).select("text", "y").mapInArrow(family, "text string, y int, family bigint")
    sample = materialise(sample.groupBy("family", "y").agg(F.min("text").alias("text")), "labelled")
    stems = learn_stems(sample)

    def measured(of, width: int, symbols: dict[int, float]) -> np.ndarray:
        """y and the features of each row of the sample."""

        def run(batches):
            scorer = Scorer(stems, symbols)
            for batch in batches:
                x = scorer.batch(batch.column("text"), getattr(scorer, of), width)
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

        rows = sample.select("text", "y").mapInArrow(run, "y int, x array<double>").collect()  # about SAMPLE rows of numbers
        got = np.array([[r.y, *r.x] for r in rows], float).reshape(-1, 1 + width)
        return got[np.lexsort(got.T)]  # the order of rows doesn't matter

    prior = np.array(list(PRIOR.values())) * SCALE
    got = measured("counts", len(PRIOR), PRIOR)
    if len(got) and 0 < got[:, 0].mean() < 1:
        learned = np.clip(fit_logistic(got[:, 1:], got[:, 0], 1.0, prior)[1:] / SCALE, 0.0, 3.0)
        symbols = dict(zip(PRIOR, learned.tolist(), strict=True))
        got = measured("text", 4, symbols)
        weights = fit_logistic(got[:, 1:], got[:, 0], prior=np.array([SCALE, 0.0, 0.0, 0.0]))
    else:
        symbols, weights = PRIOR, np.array([-3.0, SCALE, 0.0, 0.0, 0.0])
    discard(sample)
    return Model(stems, weights, symbols)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """One row per row: id, held_out, score, predicted, clause_weight (of the heaviest clause)."""
    model = fit(df, labels, id_col, text_col, label)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                z, heaviest = model.batch(part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("held_out"), pa.array(z), pa.array((z >= threshold).astype(np.int32)), pa.array(heaviest)], [id_col, "held_out", "score", "predicted", "clause_weight"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(id_col, text_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, clause_weight double")


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all their columns, that score below the threshold."""
    model = fit(df, labels, id_col, text_col, label)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.batch(part.column(text_col))[0] < threshold))

    return df.mapInArrow(run, df.schema)


def op4_toxicity(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""A quality classifier made of rules.

Statistics of a text are Spark columns. Small trees are grown on a bounded labelled sample; each path from the root is a rule, a
conjunction of comparisons. A logistic regression with an L1 penalty picks and weighs the rules, and those with a weight are
compiled into one Spark expression, so scoring stays in the JVM.

At most about SAMPLE labelled rows are learned from, whose crc32 of the id, modulo 5, isn't 0; only texts are looked at. Null texts are
empty texts and get a score from their statistics (zeros). Rows with a null id are scored and not held out; repeated ids are scored
each. Null labels aren't learned from; with no usable labels every score is 0.5. An empty table gives an empty result. Results hold
only the columns listed, so others can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import held_out, table
from .toxicity import labelled_sample

SAMPLE = 20_000
TREES, DEPTH, CUTS, LEAF = 24, 3, 24, 20
PENALTY = 2e-3
CAPITALS = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])


def statistics(text: Column) -> dict[str, Column]:
    """Columns of a text that isn't null."""
    n = F.length(text)
    w = F.split(text, " ")
    lines = F.split(text, "\n")
    n_words = F.size(w)

    def without(chars: str) -> Column:
        return n - F.length(F.translate(text, chars, ""))

    pairs = F.size(F.filter(F.zip_with(F.slice(w, F.lit(1), F.greatest(n_words - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n_words - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    per_word = F.greatest(n_words, F.lit(1))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": n / per_word,
        "capitals": without(CAPITALS) / F.greatest(n, F.lit(1)),
        "marks": without("#$%&*") / per_word,
        "bangs": without("!") / per_word,
        "pipes": without("|") / per_word,
        "digits": without("0123456789") / F.greatest(n, F.lit(1)),
        "stops": without(".") / per_word,
        "distinct_words": F.size(F.array_distinct(w)) / per_word,
        "repeated_words": pairs / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rng, rules: set) -> None:
    if path:
        rules.add(path)
    if depth == 0 or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
        return
    best = None
    for j in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
        v = x[rows, j]
        for cut in np.unique(np.quantile(v, np.linspace(0.01, 0.99, CUTS))):
            left = v <= cut
            k = int(left.sum())
            if k < LEAF or len(rows) - k < LEAF:
                continue
            p, q = y[rows[left]].mean(), y[rows[~left]].mean()
            impurity = k * p * (1 - p) + (len(rows) - k) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, int(j), float(cut), left)
    if best is None:
        return
    _, j, cut, left = best
    _grow(x, y, rows[left], depth - 1, (*path, (j, "<=", cut)), rng, rules)
    _grow(x, y, rows[~left], depth - 1, (*path, (j, ">", cut)), rng, rules)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, sign, cut in rule:
        out &= x[:, j] <= cut if sign == "<=" else x[:, j] > cut
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept, and rules with their weights."""
    if not len(y) or y.min() == y.max():
        return 0.0, []
    rng = np.random.default_rng(seed)
    rules: set[tuple] = set()
    for _ in range(TREES):
        _grow(x, y, rng.choice(len(y), len(y)), DEPTH, (), rng, rules)
    if not rules:  # too few rows to split
        return float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    listed = sorted(rules)
    z = np.stack([_holds(x, r) for r in listed], axis=1).astype(float)
    _, keep = np.unique(z, axis=1, return_index=True)
    keep = keep[(z[:, keep].mean(axis=0) > 0) & (z[:, keep].mean(axis=0) < 1)]
    listed, z = [listed[k] for k in keep], z[:, keep]
    # proximal gradient steps with momentum; the intercept has no penalty
    a = np.column_stack((np.ones(len(z)), z))
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(a))
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(1500):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - step * (a.T @ (p - y)) / len(a)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), [(r, float(k)) for r, k in zip(listed, w[1:], strict=True) if abs(k) > 1e-6]


def compile_rules(intercept: float, rules: list[tuple[tuple, float]], names: list[str]) -> Column:
    total = F.lit(intercept)
    for rule, weight in rules:
        holds = F.lit(True)
        for j, sign, cut in rule:
            holds = holds & (F.col(names[j]) <= cut if sign == "<=" else F.col(names[j]) > cut)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per row: id, held_out, score, predicted."""
    stats = statistics(F.col("text"))
    names = list(stats)
    sample = labelled_sample(df, labels, label, id_col, text_col, SAMPLE).select("y", *[c.alias(k) for k, c in stats.items()]).collect()  # about SAMPLE rows of numbers
    got = np.array(sample, float).reshape(-1, 1 + len(names))
    got = got[np.lexsort(got.T)]  # the order of rows doesn't matter
    expression = compile_rules(*fit_rules(got[:, 1:], got[:, 0]), names)
    source = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = source.select(F.col(id_col).alias("_id"), *[c.alias(k) for k, c in stats.items()]).withColumn("score", expression)
    return out.select(F.col("_id").alias(id_col), F.coalesce(held_out("_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op6_quality(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

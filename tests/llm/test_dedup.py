"""Dedup operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from arborlake.llm import _graph, _words, decontaminate, embedding_dedup, near_dup, substring_dedup


def variants(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(r.randint(3, 120))] for _ in range(40)]
    out = []
    for k in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = word()
        out.append((k * 3 % 160, " ".join(w)))
    return sorted(out)


def test_near_duplicates(spark):
    rows = variants()
    t, h, w = near_dup.weighted([x for _, x in rows])
    cut = np.searchsorted(t, np.arange(len(rows) + 1))
    part = [(h[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or near_dup.probability_jaccard(*part[i], *part[j]) >= near_dup.THRESHOLD:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {rows[k][0]: rows[root(k)][0] for k in range(len(rows))}


def test_turned_away_texts_are_still_compared(spark, monkeypatch):
    """With one band of one register, buckets hold strangers; leaders and blocks still find each pair."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = [(k, f"common shared words here again {'x' if k % 5 == 0 else k} " * (1 if k % 5 else 1) + " ".join(f"t{k % 5}w{j}" for j in range(60))) for k in range(20)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), bands=40, rows=1).collect()}
    assert all(got[k] == k % 5 for k in got)


def test_probability_jaccard():
    h = np.arange(4, dtype=np.uint64)
    x, y = np.array([1.0, 2, 3, 1]), np.array([2.0, 1, 3, 1])
    want = sum(1 / sum(max(x[b] / x[a], y[b] / y[a]) for b in range(4)) for a in range(4))
    assert near_dup.probability_jaccard(h, x, h, y) == pytest.approx(want)
    assert near_dup.probability_jaccard(h, x, h + np.uint64(9), y) == 0


def brute_spans(rows, size):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if first.setdefault(b[k : k + size], i) < i:
                gone[k : k + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("fan", [1 << 14, 2])
def test_substrings(spark, monkeypatch, fan):
    """Also with teams of blocks, and teams of teams."""
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    r = random.Random(9)
    passage = ["".join(r.choice("abé ") for _ in range(r.randint(40, 400))) for _ in range(6)]
    rows = [(k, "".join(r.choice([r.choice(passage), "".join(r.choice("xyz ") for _ in range(60)), "ab" * 40]) for _ in range(r.randint(0, 6)))) for k in range(60)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.duplicate_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == brute_spans(rows, 50)


def test_suffix_ranks():
    data = np.frombuffer(b"banana bandana banana bandana", np.uint8)
    for depth in (1, 5, 8, 13):
        rank = substring_dedup.suffix_ranks(data, depth)
        key = [bytes(data[i : i + depth]).ljust(depth, b"\0") for i in range(len(data))]
        assert [sorted(set(key)).index(k) for k in key] == rank.tolist()


def test_cutting_keeps_other_columns(spark):
    shared = "this passage is long enough to be found in both of the documents here"
    df = spark.createDataFrame([(1, shared + " one", "en", 5), (2, "two " + shared, None, None), (None, shared, "x", 1)], "doc_id bigint, text string, lang string, n_chars bigint")
    got = {r.doc_id: r for r in substring_dedup.remove_duplicates(df).collect()}
    assert got[1].text == shared + " one" and got[2].text == "two " and got[2].n_chars == 4 and got[2].lang is None and got[None].text == shared


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate((rng.normal(size=(200, 16)), centre[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * 0.12)).astype(np.float32)
    x[7], x[8], x[9] = 0, np.nan, x[10]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    y = x.astype(float)
    y[[7, 8]] = 0
    n = np.sqrt((y * y).sum(1))
    y = y / np.where(n > 0, n, 1)[:, None]
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(500)] == link.sum(1).tolist()
    label = np.arange(500)
    for _ in range(60):
        label = np.minimum(label, np.where(link, label[None], 999).min(1))
    assert [got[i].component_id for i in range(500)] == label.tolist()
    assert got[900].n_links == got[901].n_links == 0 and got[900].component_id == 900


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (3, 2), (2, 2), (5, 3), (10, 9), (20, 21)], "a bigint, b bigint")
    assert {r.node: r.component for r in _graph.components(edges).collect()} == {6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 2: 2, 3: 2, 5: 2, 20: 20, 21: 20}


def test_decontamination(spark):
    item = "In the morning the farmer Anna walked 12 km from home to Berlin and then sold 30 apples for 5 dollars to the old friend of Anna."
    bench = spark.createDataFrame([(4, item), (5, "too short"), (6, None), (None, item)], "item_id bigint, text string")
    other = item.replace("Anna", "Karl").replace("12", "90").replace("Berlin", "Paris").replace("km", "miles")
    broken = item.replace("farmer Anna", "farmer Karl")  # Anna stands for two values
    rows = [(1, "Before it. " + item + " And after."), (2, other), (3, broken), (4, "nothing to be seen here at all, only some words"), (5, None), (6, item.lower().replace("anna", "x"))]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got[1].verbatim_ids == [4] and got[2].item_ids == [4] and got[2].verbatim_ids == []
    assert not got[3].contaminated and not got[4].contaminated and not got[5].contaminated


def test_buckets_and_a_full_filter(spark, docs, sf, monkeypatch):
    """Verdicts don't depend on the buckets, nor on a filter that lets everything pass."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(decontaminate._Filter, "__call__", lambda self, g: np.arange(len(g)))
    assert {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench).collect()} == whole
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in whole.items() if not v}
    plain = {r.doc_id for r in docs.collect() if any(" ".join(b.text.lower().split()) in " ".join(r.text.lower().split()) for b in bench.collect())}
    assert plain == {k for k, v in whole.items() if v}


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, None)], "item_id bigint, text string")
    got = near_dup.near_duplicate_classes(odd).collect()
    assert len(got) >= odd.count() and {r.doc_id: r.class_id for r in got}[6] == 5 and {r.doc_id: r.class_id for r in got}[2] == 1
    assert substring_dedup.duplicate_spans(odd).count() == odd.count()
    assert substring_dedup.remove_duplicates(odd).columns == odd.columns
    assert near_dup.keep_first(odd).columns == odd.columns
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    for f in (near_dup.near_duplicate_classes, substring_dedup.duplicate_spans, substring_dedup.remove_duplicates):
        assert f(empty).count() == 0
    assert decontaminate.contamination(empty, bench.limit(0)).count() == 0
    assert embedding_dedup.links(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def near_copies(original: int, copies: int):
    """An original in the middle of the ids, and copies with 4 to 10.5 % changed shingles."""
    r = random.Random(17)
    base = [f"b{k}" for k in range(404)]
    rows = [(original, " ".join(base))]
    for c in range(copies + 1):
        if c != original:
            w = list(base)
            for k in r.sample(range(80), r.randint(4, 8)):
                w[k * 5 + 2] = f"c{c}x{k}"
            rows.append((c, " ".join(w)))
    return rows


def brute_classes(rows):
    t, h, w = near_dup.weighted([x for _, x in rows])
    cut = np.searchsorted(t, np.arange(len(rows) + 1))
    part = [(h[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    label = {i: i for i, _ in rows}
    for x in range(len(rows)):
        for y in range(x):
            a, b = label[rows[x][0]], label[rows[y][0]]
            if a != b and near_dup.probability_jaccard(*part[x], *part[y]) >= near_dup.THRESHOLD:
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def test_accepted_texts_still_meet_the_others(spark, monkeypatch):
    """The original follows a smaller copy; copies that reach 0.8 only with the original must find it all the same."""
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    rows = near_copies(150, 300)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and set(want.values()) == {0}


def nested_groups(seed: int, groups: int = 6, each: int = 22):
    """A text that is near to the centres of groups, which are near to their members, and everything else apart."""
    r = random.Random(seed)

    def change(words, n, tag):
        words = list(words)
        for k in r.sample(range(80), n):
            words[k * 5 + 2] = f"{tag}x{k}"
        return words

    texts = [[f"b{k}" for k in range(404)]]
    for g in range(groups):
        centre = change(texts[0], 8, f"g{g}")
        texts.append(centre)
        texts += [change(centre, r.randint(5, 7), f"g{g}c{c}") for c in range(each)]
    r.shuffle(texts)
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize("seed", [0, 1])
def test_a_text_bridges_more_than_two_groups(spark, seed):
    rows = nested_groups(seed)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def items_found(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.item_ids == [1] for r in decontaminate.contamination(rows, bench).orderBy("doc_id").collect()]


def test_other_values_are_found(spark):
    item = "Tom has 5 apples. Anna gives him 3 more apples. Tom eats 2 apples. How many apples does Tom have left"
    other = item.replace("Tom", "Mary Ann").replace("Anna", "Karl").replace("5", "1,250").replace("3", "2.5")
    longer = item.replace("more apples. Tom", "more apples at noon. Tom")
    texts = [other, item.replace("Tom", "Ben").replace("Anna", "Lisa"), item.lower(), item.upper(), item.replace(" ", "\n"), item.replace("5", "2").replace("3", "2"), longer.replace("Anna", "Jo Ann"), "Tom has nothing to do with any of this"]
    assert items_found(spark, item, texts) == [True] * 7 + [False]


def test_items_without_windows_and_long_runs(spark):
    short = "What is the capital of France?"
    assert items_found(spark, short, ["He asked: what is the capital of France? Paris.", "What is the capital of Spain?", "What is the name of Spain?", None]) == [True, True, False, False]
    table = " ".join(f"{k} km" for k in range(9))
    assert items_found(spark, table, ["see " + table + " there", table.replace("3 km", "33 km")]) == [True, False]
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    assert items_found(spark, " ".join(words), ["x " + " ".join(words[20:65]) + " y", "x " + " ".join(words[20:35]) + " y"]) == [True, False]


def test_embeddings_of_two_lengths(spark):
    rows = [(k, [1.0, float(k), 2.0]) for k in range(6)] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1.0, 2.1]), (13, [-1.0, 2.0]), (14, [3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert [got[k] for k in (10, 11, 12, 13, 14)] == [(2, 10), (2, 10), (2, 10), (0, 13), (0, 14)]


@pytest.mark.parametrize("n", range(7))
def test_batches_of_few_words(spark, n):
    text = " ".join("one two three four five six".split()[:n])
    one = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in near_dup.near_duplicate_classes(one).collect()] == [(1, 1, True)]
    h, t = _words.shingles(_words.words([text]), 5)
    assert len(h) == min(n, 1) + max(0, n - 5)


@pytest.mark.parametrize("seed", range(3))
def test_many_near_copies_around_the_threshold(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    r = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for c in range(300):
        w = list(base)
        for k in r.sample(range(120), r.randint(1, 3)):
            w[k] = f"c{r.randrange(10**6)}"
        rows.append((c, " ".join(w)))
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_repeated_ids_with_different_texts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (2, "other words"), (2, long), (3, "other words"), (4, long + " end"), (None, long)]
    got = {(r.doc_id, r.class_id) for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (4, 1) in got and (2, 1) in got and (None, None) in got


def brute_links(x):
    n = np.sqrt((x * x).sum(1))
    y = x / np.where(n > 0, n, 1)[:, None]
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None], len(x)).min(1))
        if (new == label).all():
            return link.sum(1).tolist(), label.tolist()
        label = new


def test_many_lists_blocks_and_recall(spark, monkeypatch):
    """Lists enough for probes to matter, both sides in blocks, a third of all rows in one group of near copies."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(300, 24))
    x = centre[rng.integers(0, 300, 9000)] + rng.normal(size=(9000, 24)) * rng.choice([0.05, 0.16, 0.25], 9000)[:, None]
    x[::3] = centre[0] + rng.normal(size=(3000, 24)) * 0.08
    x[5:60:7] = x[4]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.links(df.repartition(8)).collect()}
    want, label = brute_links(x)
    found = [got[i].n_links for i in range(len(x))]
    assert all(f <= w for f, w in zip(found, want, strict=True)) and sum(found) >= 0.999 * sum(want)
    if found == want:
        assert [got[i].component_id for i in range(len(x))] == label


def test_double_precision_and_odd_vectors(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e300, 1e300]), (3, [1e-300, 1e-300]), (4, [1.0, None]), (5, []), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as kept", "'x' as n_links", "'x' as rep")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.links(df).collect()), key=str)
    assert got == sorted([(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 0, None), (7, 0, 7), (8, 4, 1), (8, 4, 1)], key=str)


def plain_template(text):
    """Tokens (canonical, value) of a text without names, by regular expressions."""
    out = []
    for w in re.findall(r"[A-Za-z0-9]+", text):
        low = w.lower()
        out.append(("#" if any(c.isdigit() for c in w) or low in decontaminate.NUMBER_WORDS else "u" if low in decontaminate.UNITS else low, low))
    return out


def test_templates_against_brute_force(spark):
    """Items and documents in small letters, with numbers and units: all alignments by trying every place."""
    r = random.Random(2)
    words = "the old farmer sold apples pears from home then walked along some river bank near trees".split()

    def question():
        return [r.choice([r.choice(words), r.choice(words), str(r.randint(1, 9)), r.choice(["km", "miles"])]) for _ in range(16)]

    items = [question() for _ in range(12)] + [["how", "many", "apples", "has", "he", "bought"]]
    docs = []
    for _ in range(120):
        t = list(r.choice(items))
        for k, w in enumerate(t):
            if w.isdigit() and r.random() < 0.5:
                t[k] = r.choice([str(r.randint(1, 9)), "seven"])
            elif r.random() < 0.04:
                t[k] = r.choice(words)
        docs.append(" ".join([r.choice(words) for _ in range(r.randint(0, 5))] + t + [r.choice(words) for _ in range(r.randint(0, 5))]))

    def found(item, doc):
        a, b = plain_template(item), plain_template(doc)
        size = min(8, len(a))
        usable = [p for p in range(len(a) - size + 1) if sum(x[0] not in "#u" for x in a[p : p + size]) >= 4 + (len(a) < 8)]
        for shift in range(-len(a), len(b)):
            hit = [p for p in usable if 0 <= p + shift <= len(b) - size and [x[0] for x in a[p : p + size]] == [x[0] for x in b[p + shift : p + shift + size]]]
            if usable and len(hit) >= 0.5 * len(usable):
                places = sorted({p + k for p in hit for k in range(size)})
                more = set()
                for step, edge in ((-1, places[0]), (1, places[-1])):  # on as far as plain words agree
                    p, held = edge + step, []
                    while 0 <= p < len(a) and 0 <= p + shift < len(b):
                        held.append(p)
                        if a[p][0] not in "#u":
                            if a[p][1] != b[p + shift][1]:
                                break
                            more |= set(held)
                        p += step
                pairs = {(a[p][1], b[p + shift][1]) for p in {*places} | more if a[p][0] in "#u"}
                if len({x for x, _ in pairs}) == len(pairs):
                    return True
        return False

    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {x.doc_id: set(x.item_ids) for x in decontaminate.contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), bench).collect()}
    want = {k: {i for i, t in enumerate(items) if found(" ".join(t), d)} for k, d in enumerate(docs)}
    missed = [(k, want[k] - got[k]) for k in want if want[k] - got[k]]
    assert not missed and 40 < sum(map(len, want.values()))
    assert sum(len(got[k] - want[k]) for k in got) <= 0.05 * sum(map(len, want.values()))  # chains over shifted places

"""Closures that are counted without their pairs."""

import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import graphs
from arborlake.plans import queries


def brute(edges, seeds):
    step = {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    out = {}
    for s in seeds:
        seen, todo = {s}, [s]
        while todo:
            for b in step.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[s] = (len(seen), max(seen))
    return out


@pytest.mark.parametrize("fan", [1, 2])
def test_reach_counts_tails_rings_and_stops(spark, fan):
    r = random.Random(fan)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(200 + k, 201 + k) for k in range(9)] + [(209, 103), (300, 300), (301, 300)]
    edges += [(400 + k, 400 + r.randrange(60)) for k in range(60) for _ in range(fan) if k % 5]
    seeds = sorted({a for e in edges for a in e} | {999})
    got = graphs.reach(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(s,) for s in seeds], "seed long"))
    assert {x.seed: (x.n, x.top) for x in got.collect()} == brute(edges, seeds)


def test_closure_makes_no_pairs(spark, tmp_path, monkeypatch):
    """Parts whose number is a multiple of 3 have rings of many keys; no table of pairs is made of them."""
    monkeypatch.setattr(graphs, "reachable", None)
    spark.range(600).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = {x.seed: (x.n, x.top) for x in queries.QUERIES["reachability_closure"](spark, str(tmp_path)).collect()}
    assert got == brute([(k, (k * 7 + 3) % 600) for k in range(600) if k % 3], range(600))

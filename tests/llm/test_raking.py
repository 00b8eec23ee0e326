from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import raking as op
from tests.llm.cases import documents, empty, frame


def test_marginals_reach_their_targets(spark):
    cells = [(f"s{i}", f"l{j}", f"t{k}", (i + 1) * (j + 2) * (k + 1) + i * j) for i in range(5) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(cells, "a string, b string, c string, tokens long")
    got = op.rake(df, ["a", "b", "c"], 0.5, 12).collect()
    for i, k in enumerate("abc"):
        tokens, weight = defaultdict(float), defaultdict(float)
        for r in got:
            tokens[r[k]] += r.tokens
            weight[r[k]] += r.w
        mass = sum(t**0.5 for t in tokens.values())
        for v, t in tokens.items():
            assert abs(weight[v] / sum(weight.values()) - t**0.5 / mass) < 1e-6


def brute(rows, power, sweeps):
    """The same steps over dictionaries."""
    cells = defaultdict(float)
    for r in rows:
        cells[r["__0"], r["__1"], r["__2"]] += r["__n"]
    w = dict(cells)
    for _ in range(sweeps):
        for d in range(3):
            have, tokens = defaultdict(float), defaultdict(float)
            for c in cells:
                have[c[d]] += w[c]
                tokens[c[d]] += cells[c]
            mass = sum(t**power for t in tokens.values())
            for c in cells:
                w[c] = w[c] * (tokens[c[d]] ** power / mass) / have[c[d]] if have[c[d]] else 0.0
    factor = {c: w[c] / n for c, n in cells.items() if n}
    top = max(factor.values())
    return {c: min(1.0, factor[c] / top) if c in factor else 1.0 for c in cells}


def test_documents_and_probabilities(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = op.mix_sources(docs, power=0.7, sweeps=3, tolerance=1.0).collect()
    assert len(got) == len(rows)
    p = brute(got, 0.7, 3)
    for r in got:
        assert abs(r["__p"] - p[r["__0"], r["__1"], r["__2"]]) < 1e-9
        assert r["doc_id"] is not None or r["__keep"]
    assert {r["__keep"] for r in got} == {True, False}
    assert sum(r["__n"] for r in got if r["doc_id"] == 305) == 1


def test_given_targets_are_met(spark):
    """Marginals of the raked weights equal the targets; a value without one gets nothing."""
    cells = [(f"s{i}", f"l{j}", (i + 1) * (j + 2) + i * j) for i in range(4) for j in range(3)]
    df = spark.createDataFrame(cells, "a string, b string, tokens long")
    wanted = {0: {"s0": 5, "s1": 1, "s2": 2}, 1: {"l0": 1, "l1": 1, "l2": 2}}
    targets = spark.createDataFrame([(d, v, float(w)) for d, x in wanted.items() for v, w in x.items()], "dim int, value string, weight double")
    got = op.rake(df, ["a", "b"], 1.0, 4, targets, tolerance=1e-9).collect()
    for d, k in enumerate("ab"):
        for v in {r[k] for r in got}:
            share = sum(r.w for r in got if r[k] == v) / sum(r.w for r in got)
            assert abs(share - wanted[d].get(v, 0) / sum(wanted[d].values())) < 1e-6


def test_targets_that_contradict_each_other_warn(spark):
    df = spark.createDataFrame([("x", "p", 5), ("y", "q", 5)], "a string, b string, tokens long")
    targets = spark.createDataFrame([(0, "x", 1.0), (0, "y", 1.0), (1, "p", 3.0), (1, "q", 1.0)], "dim int, value string, weight double")
    with pytest.warns(UserWarning, match="can't be met"):
        op.rake(df, ["a", "b"], 1.0, 20, targets)


def test_clashing_columns_keep_their_values(spark):
    docs = frame(spark).selectExpr("*", "7 as __n", "8 as __f", "'k' as __keep", "9 as __0", "10 as tokens", "11 as d0", "12 as f")
    names = op.names_for(docs)
    got = op.mix_sources(docs, names=names)
    assert set(docs.columns) < set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert {(r["__n"], r["__f"], r["__keep"], r["__0"], r.tokens, r.d0, r.f) for r in got.collect()} == {(7, 8, "k", 9, 10, 11, 12)}
    assert got.where(names.keep).count() == op.mix_sources(frame(spark)).where("__keep").count()


def test_keep_rate_follows_the_probability(spark):
    ids = spark.range(20_000).select(op.unit_hash(F.col("id")).alias("u"))
    assert abs(ids.where("u < 0.3").count() / 20_000 - 0.3) < 0.02


def test_topics(spark):
    texts = [None, "", "a b", "x " * 500, "x " * 3000, "LOUD WORDS", "a### b### c###"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(op.topic_of(F.col("t"))).collect()]
    assert got == ["empty", "empty", "short", "article", "long", "shouting", "symbols"]


def test_empty_table_and_texts_without_words(spark):
    assert op.mix_sources(empty(spark)).count() == 0
    got = op.mix_sources(frame(spark, [(1, ""), (2, None)])).collect()
    assert all(r["__keep"] and r["__p"] == 1 for r in got)

"""Chi-square and rank correlation against brute force; one huge class, ties, nulls, constants."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest

from tidemark.operators import ranking
from tidemark.plans import reports


def average_ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def rows(n=600):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        a = float(rng.integers(0, 12))
        out.append((a, float("nan") if i % 11 == 0 else rng.normal() + a, 1.0, None if i % 13 == 0 else f"c{i % 7}", "hot" if i % 3 else f"v{i}", int(rng.random() < a / 12)))
    return out


SCHEMA = "a double, b double, flat double, c string, d string, label int"


def test_ranking_by_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data + [(5.0, 5.0, 2.0, "x", "y", None)], SCHEMA)
    got = {r.feature: r for r in ranking.feature_ranking(df, ["a", "b", "flat"], ["c", "d"]).collect()}
    y = average_ranks([r[5] for r in data])
    for k, name in enumerate(("a", "b")):
        x = average_ranks([0.0 if math.isnan(r[k]) else r[k] for r in data])
        assert abs(got[name].spearman - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert got["flat"].spearman is None
    for k, name in ((3, "c"), (4, "d")):
        cells, vals, labels = Counter((r[k], r[5]) for r in data), Counter(r[k] for r in data), Counter(r[5] for r in data)
        want = sum((cells[v, t] - m * u / len(data)) ** 2 / (m * u / len(data)) for v, m in vals.items() for t, u in labels.items())
        assert abs(got[name].chisq - want) < 1e-9
    assert sorted((got["c"].chisq_rank, got["d"].chisq_rank)) == [1, 2]


def test_p_values_match_the_library_test(spark):
    df = spark.createDataFrame([(float(i % 5), float(i * i % 3), float((i * i + i // 7) % 4 == 0)) for i in range(500)], "u double, v double, label double")
    tests = ChiSquareTest.test(VectorAssembler(inputCols=["u", "v"], outputCol="f").transform(df), "f", "label").first()
    got = {r.feature: r for r in ranking.feature_ranking(df, [], ["u", "v"]).collect()}
    for i, name in enumerate(("u", "v")):
        assert abs(got[name].p_value - tests.pValues[i]) < 1e-9 and abs(got[name].chisq - tests.statistics[i]) < 1e-9


def test_gamma_share_by_known_values():
    assert abs(ranking.upper_gamma_share(1.0, 2.5) - math.exp(-2.5)) < 1e-14
    assert abs(ranking.chi_square_p(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(ranking.chi_square_p(11070.5, 11070) - 0.4961) < 5e-3
    assert ranking.chi_square_p(0.0, 3) == 1.0 == ranking.chi_square_p(5.0, 0)


def test_empty_and_missing(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    assert ranking.feature_ranking(df.limit(0), ["a"], ["c"]).count() == 0
    with pytest.raises(ValueError):
        ranking.feature_ranking(df, [], [])


def test_timing_quantiles_of_a_hot_key_null_key_and_odd_values(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v), float(v) / 4) for v in rng.gamma(2.0, 30.0, 4000).round(2)]
    rows += [(None, 1.0, None), (None, 4.0, 2.0), ("none", None, None), ("odd", float("nan"), 1.0), ("odd", 3.0, 1.0)]
    table = spark.createDataFrame(rows, "encoder string, full_ms double, encoder_ms double")
    got = {r.encoder: r for r in reports.timing_summary(table, ["encoder"], 10).collect()}
    assert set(got) == {"hot", None, "none", "odd"}
    x = np.array([r[1] for r in rows[:4000]])
    assert np.isclose(got["hot"].full_ms_p50, np.quantile(x, 0.5)) and np.isclose(got["hot"].full_ms_p95, np.quantile(x, 0.95))
    assert np.isclose(got["hot"].encoder_ms_p95, np.quantile(x / 4, 0.95)) and got["hot"].n_runs == 4000
    assert got[None].full_ms_p50 == 2.5 and got[None].encoder_ms_p95 == 2.0
    assert got["none"].full_ms_p50 is None and got["none"].encoder_share == 0.0
    assert got["odd"].full_ms_p50 == 3.0
    assert reports.timing_summary(table.limit(0), ["encoder"], 10).count() == 0

"""Ordered building blocks against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.functions import scale


@pytest.fixture(scope="module")
def numbers(spark):
    # 3000 rows, a third of them share one value
    return spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 ELSE pmod(hash(id), 1000) END AS v").repartition(7)


def test_ordinal_is_a_global_position(numbers):
    placed, n = scale.with_ordinal(numbers, ["v", "id"])
    rows = sorted(map(tuple, placed.select("v", "id", "ordinal").collect()))
    assert n == 3000 and [r[2] for r in rows] == list(range(3000))
    # the shared value is spread over several blocks
    blocks = scale.sorted_blocks(numbers, ["v", "id"]).filter("v = 5").select("_block").distinct().count()
    assert blocks > 1


def test_ordinal_of_nothing(numbers):
    placed, n = scale.with_ordinal(numbers.limit(0), ["id"])
    assert n == 0 and placed.count() == 0


def test_running_totals(numbers):
    histogram = numbers.groupBy("v").agg(F.count("*").alias("n"))
    running, totals = scale.with_running_totals(histogram, ["v"], {"upto": "n"})
    rows = sorted(map(tuple, running.collect()))
    assert totals["upto"] == 3000
    assert [r[2] for r in rows] == np.cumsum([r[1] for r in rows]).tolist()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_matches_linear_interpolation(numbers, q):
    values = [r.v for r in numbers.collect()]
    got = scale.exact_quantile(numbers.withColumn("v", F.col("v").cast("double")), "v", q, "x").first().x
    assert got == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_quantile_of_nothing_is_null(numbers):
    assert scale.exact_quantile(numbers.limit(0), "v", 0.5, "x").first().x is None


@pytest.mark.parametrize("k", [3, 500])
def test_top_rows_are_the_first_of_the_order(numbers, k):
    got = sorted(map(tuple, scale.top_rows(numbers, [F.desc("v"), F.asc("id")], k).collect()))
    expected = sorted(((r.v, r.id) for r in numbers.collect()), key=lambda t: (-t[0], t[1]))[:k]
    assert sorted((i, v) for v, i in expected) == got


def test_rank_within_matches_a_window(numbers):
    ranked = scale.rank_within(numbers, "v", [F.desc("id")], "r").collect()
    by_value: dict[int, list] = {}
    for row in ranked:
        by_value.setdefault(row.v, []).append((-row.id, row.r))
    for rows in by_value.values():
        assert [r for _, r in sorted(rows)] == list(range(1, len(rows) + 1))



@pytest.mark.parametrize("border", [0, 65_536])
def test_cut_takes_the_same_rows_as_a_sort(spark, border):
    rng = np.random.default_rng(4)
    tailed = np.round(np.exp(rng.normal(0, 12, 400)) * rng.choice([-1, 1], 400), 6)
    texts = [*map(float, tailed), *[0.0] * 300, *[2.5] * 90, 1e-6, 2e-6, float("inf"), float("-inf"), float("nan"), float("nan"), None, None]
    close = [1.0 + i * 2.0**-52 for i in range(len(texts))]
    df = spark.createDataFrame([(i, v, close[i]) for i, v in enumerate(texts)], "id bigint, v double, w double").repartition(5)

    def descending(i):
        v = texts[i]
        return (2, 0, i) if v is None else (0, 0, i) if v != v else (1, -v, i)

    places = sorted(range(len(texts)), key=descending)
    for k in (2, 3, 400, len(texts) - 1, 5000):
        cuts = scale.top_cuts(df, ["v", "w"], k, border)
        chosen = scale.rows_of_cut(df, cuts["v"], [F.desc("v"), "id"])
        assert sorted(r.id for r in chosen.collect()) == sorted(places[:k])
        chosen = scale.rows_of_cut(df, cuts["w"], [F.desc("w"), "id"])
        assert sorted(r.id for r in chosen.collect()) == list(range(len(texts)))[-k:]


def test_cut_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "id bigint, v double")
    assert scale.rows_of_cut(empty, scale.top_cuts(empty, ["v"], 3)["v"], [F.desc("v"), "id"]).count() == 0
    same = spark.range(1000).select("id", F.lit(7.0).alias("v"))
    cut = scale.top_cuts(same, ["v"], 10, 0)["v"]
    assert (cut.wanted, cut.border_rows) == (10, 1000)
    assert sorted(r.id for r in scale.rows_of_cut(same, cut, [F.desc("v"), "id"]).collect()) == list(range(10))
    with pytest.raises(ValueError):
        scale.top_cuts(same, ["v"], 0)


def test_cut_sorts_the_border_only(spark):
    df = spark.range(200_000).select("id", (F.pmod(F.hash("id"), F.lit(1_000_003)) / 7).alias("v"))
    cut = scale.top_cuts(df, ["v"], 70_000, 500)["v"]
    assert 0 < cut.wanted <= cut.border_rows <= 500
    chosen = scale.rows_of_cut(df, cut, [F.desc("v"), "id"])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower() and "Sort" not in plan and chosen.count() == 70_000


def test_a_stored_table_is_read_by_column(spark):
    kept = scale.stored(spark.range(20).selectExpr("id", "id * 2 AS twice", "CAST(id AS STRING) AS name"))
    assert kept.dtypes == [("id", "bigint"), ("twice", "bigint"), ("name", "string")]
    read = kept.filter("id > 4").select("twice")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,twice:bigint>" in plan and "GreaterThan(id,4)" in plan
    assert sorted(row[0] for row in read.collect()) == [2 * i for i in range(5, 20)]

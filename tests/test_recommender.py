"""Retrieval and ranking against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import ranking, retrieval, validate
from bazaarflow.plans import recommender, registry

PAIRS = "user_idx bigint, item_idx bigint"
VECTOR_USERS, VECTOR_ITEMS = "user_idx bigint, vector array<double>", "item_idx bigint, vector array<double>"


def brute_force(users, items, seen, k):
    out = set()
    for u, uv in users.items():
        scores = sorted(((-float(np.dot(uv, iv)), i) for i, iv in items.items() if (u, i) not in seen))[:k]
        out |= {(u, rank, i) for rank, (_, i) in enumerate(scores, 1)}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    users = {u: rng.standard_normal(8) for u in range(60)}
    users[7] = np.zeros(8)  # all its scores are equal
    items = {i: rng.standard_normal(8) for i in range(90)}
    # user 3 has seen nearly everything, user 4 everything
    seen = {(u, int(i)) for u in range(60) for i in rng.choice(90, 5, replace=False)} | {(3, i) for i in range(88)} | {(4, i) for i in range(90)}
    frames = (
        spark.createDataFrame([(u, v.tolist()) for u, v in users.items()], VECTOR_USERS),
        spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], VECTOR_ITEMS),
        spark.createDataFrame(sorted(seen), PAIRS),
    )
    return frames, brute_force(users, items, seen, 10)


def triples(df):
    return {(r.user_idx, r["rank"], r.item_idx) for r in df.collect()}


def test_exact_search_in_blocks(vectors):
    frames, expected = vectors
    assert triples(retrieval.embedding_top_k(*frames, 10)) == expected
    dim = len(frames[1].first().vector)
    assert triples(retrieval.embedding_top_k(*frames, 10, block_bytes=16 * 8 * dim)) == expected


def test_blocks_of_short_vectors_are_skipped(spark, monkeypatch):
    """Lengths fall by the item's number: most (user, block) pairs cannot change a list; all rows are as without skipping."""
    rng = np.random.default_rng(4)
    users = {u: rng.standard_normal(6) for u in range(40)}
    users[3] = np.zeros(6)
    items = {i: rng.standard_normal(6) * 0.97**i for i in range(400)}
    seen = {(u, i) for u in users for i in range(u % 5)}
    asked, plain = [], retrieval._scored_blocks
    monkeypatch.setattr(retrieval, "_scored_blocks", lambda own, *rest: asked.append(own) or plain(own, *rest))
    frames = (
        spark.createDataFrame([(u, v.tolist()) for u, v in users.items()], VECTOR_USERS),
        spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], VECTOR_ITEMS),
        spark.createDataFrame(list(seen), PAIRS),
    )
    found = triples(retrieval.embedding_top_k(*frames, 5, block_bytes=20 * 8 * 6, head_items=20))
    assert found == brute_force(users, items, seen, 5)
    assert asked[0].count() == 40 and asked[1].count() < 40 * 19 / 3
    assert asked[1].filter("user_idx = 3").count() == 19


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_few_items(spark, n):
    users = {u: np.array([1.0, u]) for u in range(6)}
    items = {i: np.array([i, 2.0]) for i in range(n)}
    frames = (
        spark.createDataFrame([(u, v.tolist()) for u, v in users.items()], VECTOR_USERS),
        spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], VECTOR_ITEMS),
        spark.createDataFrame([(0, 0)], PAIRS),
    )
    expected = brute_force(users, items, {(0, 0)}, 3)
    assert triples(retrieval.embedding_top_k(*frames, 3)) == expected
    assert triples(retrieval.approx_top_k(*frames, 3)) == expected


def test_scores_in_small_steps(vectors, monkeypatch):
    frames, expected = vectors
    users, items, seen = (f.toPandas() for f in frames)
    monkeypatch.setattr(retrieval, "SCORES_IN_MEMORY", 200)
    hidden = [seen[seen.user_idx == u].item_idx.to_numpy() for u in users.user_idx]
    part = retrieval._rank_block(
        users.user_idx.to_numpy(), retrieval._matrix(users.vector), hidden, items.item_idx.to_numpy(), retrieval._matrix(items.vector), 10
    )
    assert set(zip(part.user_idx, part.item_idx)) == {(u, i) for u, _, i in expected}


def test_approximate_search_finds_most_and_probing_all_finds_everything(vectors):
    frames, expected = vectors
    dim = len(frames[1].first().vector)
    found = triples(retrieval.approx_top_k(*frames, 10, probes=4, block_bytes=5 * 8 * dim))
    overlap = {(u, i) for u, _, i in found} & {(u, i) for u, _, i in expected}
    assert len(overlap) > 0.6 * len(expected)
    assert triples(retrieval.approx_top_k(*frames, 10, probes=90, block_bytes=20 * 8 * dim)) == expected


def test_approximate_lists_are_as_long_as_exact_ones(spark):
    """One far cluster of a few items: a user next to it still gets a full list."""
    rng = np.random.default_rng(4)
    near, far = rng.normal(0, 0.01, (6, 4)) + 5, rng.normal(0, 0.01, (394, 4)) - 5
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack((near, far)))], VECTOR_ITEMS)
    users = spark.createDataFrame([(0, [5.0] * 4), (1, [-5.0] * 4)], "user_idx bigint, vector array<double>")
    seen = spark.createDataFrame([(0, i) for i in range(10, 390)] + [(1, 0)], PAIRS)
    lists = triples(retrieval.approx_top_k(users, items, seen, 20, probes=1))
    assert [sum(u == user for u, _, _ in lists) for user in (0, 1)] == [20, 20]
    assert not {(0, i) for i in range(10, 390)} & {(u, i) for u, _, i in lists}


def test_popularity_lists_of_a_user_who_has_seen_nearly_everything(spark):
    scores = spark.createDataFrame([(i, float(500 - i)) for i in range(500)], "item_idx bigint, score double")
    users = spark.createDataFrame([(0,), (1,), (2,)], "user_idx bigint")
    seen = spark.createDataFrame([(0, i) for i in range(500) if i % 50 != 7] + [(1, 0), (1, 2), (1, 2)], PAIRS)
    frame = retrieval.popularity_top_k(scores, users, seen, 5)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "array_except" not in plan
    assert triples(frame) == {(u, r + 1, i) for u, own in ((0, [7, 57, 107, 157, 207]), (1, [1, 3, 4, 5, 6]), (2, range(5))) for r, i in enumerate(own)}


def test_stray_split_names_are_ignored(spark):
    rows = [("u", name, "i") for name in ("train", "val", "test", "a", "b", "c", "d", "e")]
    frame = spark.createDataFrame(rows, "user_id string, split string, item_id string")
    assert retrieval.split_interactions(frame).count() == 3
    with pytest.raises(ValueError, match="val"):
        retrieval.split_interactions(frame.filter("split <> 'val'"))


def test_factor_ids_beyond_the_solver_are_refused(spark):
    with pytest.raises(ValueError, match="32-bit"):
        retrieval.als_retriever(spark.createDataFrame([(2**31, 0)], PAIRS))


def test_dot_products_and_unit_rows(vectors):
    (users, items, _), _ = vectors
    pairs = users.select("user_idx").join(items.select("item_idx"), F.col("user_idx") == F.col("item_idx"))
    scores = {r.user_idx: r.score for r in retrieval.dot_product_scores(users, items, pairs).collect()}
    u, i = (np.array(f.orderBy(f.columns[0]).collect()[5].vector) for f in (users, items))
    assert scores[5] == pytest.approx(float(u @ i))
    unit = {r.user_idx: r.vector for r in retrieval.l2_normalize_rows(users).collect()}
    assert np.linalg.norm(unit[5]) == pytest.approx(1.0) and set(unit[7]) == {0.0}


@pytest.fixture(scope="module")
def popular(spark):
    """40 items with tied popularity; one user has seen almost all of them."""
    scores = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "item_idx bigint, score double")
    seen = {(0, i) for i in range(38)} | {(1, 4), (1, 9)} | {(2, i) for i in range(40)}
    users = spark.createDataFrame([(u,) for u in range(4)], "user_idx bigint")
    return scores, users, seen


def test_popular_lists(spark, popular):
    scores, users, seen = popular
    got = triples(retrieval.popularity_top_k(scores, users, spark.createDataFrame(sorted(seen), PAIRS), 6))
    order = sorted(range(40), key=lambda i: (-(i % 5), i))
    expected = {(u, r, i) for u in range(4) for r, i in enumerate([i for i in order if (u, i) not in seen][:6], 1)}
    assert got == expected
    assert {u for u, _, _ in got} == {0, 1, 3}


def test_popularity_counts_rows_or_users(spark):
    splits = spark.createDataFrame([("u1", "a", "train"), ("u1", "a", "train"), ("u2", "b", "train"), ("u2", "a", "test")], "user_id string, item_id string, split string")
    index = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "item_id string, item_idx bigint")
    by_rows = {r.item_id: r.score for r in retrieval.popularity_scores(splits, index).collect()}
    assert by_rows == pytest.approx({"a": 1.0, "b": math.log(2) / math.log(3), "c": 0.0})
    by_users = {r.item_id: r.score for r in retrieval.popularity_scores(splits, index, "linear", distinct_users=True).collect()}
    assert by_users == {"a": 1.0, "b": 1.0, "c": 0.0}
    with pytest.raises(ValueError):
        retrieval.popularity_scores(splits, index, "square")
    with pytest.raises(ValueError, match="val"):
        retrieval.split_interactions(splits)


def test_items_with_many_buyers_are_ranked_however_few_their_rows(spark):
    """Fifty items bought again and again by one user each stand before, by rows, an item that many users bought once."""
    rows = [(f"heavy{i}", f"item{i:02d}", "train") for i in range(50) for _ in range(9)] + [(f"light{i}", "wide", "train") for i in range(5)]
    rows = spark.createDataFrame(rows, "user_id string, item_id string, split string")
    names = {"user": sorted({r.user_id for r in rows.collect()}), "item": sorted({r.item_id for r in rows.collect()})}
    users, items = (spark.createDataFrame([(x, i) for i, x in enumerate(names[n])], f"{n}_id string, {n}_idx bigint") for n in ("user", "item"))
    gold = recommender.RecommenderGold(rows, users, items, retrieval.positive_pairs(rows, users, items), users.count(), items.count())
    buyers = {r.item_id: r.n for r in rows.groupBy("item_id").agg(F.count_distinct("user_id").alias("n")).collect()}
    seen = {(r.user_id, r.item_id) for r in rows.collect()}
    expected = set()
    for u, name in enumerate(names["user"]):
        pool = sorted((-buyers[item], i) for i, item in enumerate(names["item"]) if (name, item) not in seen)
        expected |= {(u, place, i) for place, (_, i) in enumerate(pool[:20], 1)}
    assert triples(registry._rank_candidates(gold)) == expected


def test_candidate_pool(spark):
    users = spark.createDataFrame([(0,), (1,)], "user_idx bigint")
    items = spark.createDataFrame([(i,) for i in range(4)], "item_idx bigint")
    seen = spark.createDataFrame([(0, 0), (0, 1)], PAIRS)
    pool = {r.user_idx: (r.seen_items, r.candidate_items) for r in retrieval.candidate_items(users, items, seen).collect()}
    assert pool == {0: (2, 2), 1: (0, 4)}


@pytest.fixture(scope="module")
def interactions(spark):
    rng = np.random.default_rng(5)
    taste = rng.random((50, 3)) @ rng.random((3, 30))
    dense = (taste + 0.3 * rng.random((50, 30)) > 1.1).astype(float)
    dense[:, 0] = 1.0  # one item is bought by everybody
    pairs = spark.createDataFrame([(int(u), int(i)) for u, i in zip(*dense.nonzero())], PAIRS)
    return dense, pairs


def weighted_matrix(dense):
    weights = dense * np.log1p(dense.shape[0] / np.maximum(dense.sum(axis=0), 1))
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("block_pairs", [200_000, 8])
def test_factors_span_the_leading_singular_space(interactions, block_pairs):
    # with 8 pairs to a block most users are too long for one and are multiplied by joins
    dense, pairs = interactions
    assert (dense.sum(axis=1) > 8).any() and (dense.sum(axis=1) <= 8).any()
    weighted = retrieval.tfidf_interactions(pairs, 50)
    users, items = retrieval.mf_factors(weighted, 50, 30, components=5, n_iter=8, block_pairs=block_pairs)
    u = np.zeros((50, 5))
    for row in users.collect():
        u[row.user_idx] = row.vector
    v = np.zeros((30, 5))
    for row in items.collect():
        v[row.item_idx] = row.vector
    left, strength, right = np.linalg.svd(weighted_matrix(dense), full_matrices=False)
    best = (left[:, :5] * strength[:5]) @ right[:5]
    assert np.abs(u @ v.T - best).max() < 1e-3
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-6)


def test_pairs_stay_where_they_are_in_a_round(interactions):
    _, pairs = interactions
    blocks = retrieval._PairBlocks(retrieval.tfidf_interactions(pairs, 50), 200_000)
    rows = blocks.light.select("item_idx").distinct().select("item_idx", *(F.rand(3).alias(f"q{i}") for i in range(4)))
    frame = blocks.product(rows, np.eye(4), 4, "item_idx")
    exchanges = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and not [line for line in exchanges if "(block" in line or "user_idx" in line]
    # item rows to their routes, to the blocks and back; the pairs' side of the cogroup has no exchange
    above = frame._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in above
    assert sum("hashpartitioning(to_block" in line for line in exchanges) == 1


def test_binary_weighting(interactions):
    _, pairs = interactions
    assert {r.weight for r in retrieval.tfidf_interactions(pairs, 50, "binary").collect()} == {1.0}
    with pytest.raises(ValueError):
        retrieval.tfidf_interactions(pairs, 50, "bm25")


def test_learned_vectors_are_repeatable_and_unit_length(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], PAIRS)
    runs = [retrieval.als_retriever(pairs, rank=4, max_iter=3) for _ in range(2)]
    first, second = ({r.item_idx: tuple(r.vector) for r in items.collect()} for _, items in runs)
    assert first == second and set(first) == {0, 1, 2}
    assert all(np.linalg.norm(v) == pytest.approx(1.0) for v in first.values())


def test_negatives_are_in_range_and_repeatable(interactions):
    _, pairs = interactions
    drawn = retrieval.sampled_negatives(pairs, 3, 30)
    assert drawn.count() == 3 * pairs.count()
    assert drawn.filter("negative_idx < 0 OR negative_idx >= 30").count() == 0
    assert drawn.exceptAll(retrieval.sampled_negatives(pairs.repartition(9), 3, 30)).count() == 0
    assert drawn.select("negative_idx").distinct().count() == 30


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(0, 10, 1), (0, 11, 2), (0, 12, 3), (1, 10, 1), (1, 13, 2)], "user_idx bigint, item_idx bigint, rank int")
    truth = spark.createDataFrame([(0, 11), (0, 12), (0, 99), (0, 98), (1, 50), (2, 10)], PAIRS)
    rows = {r.user_idx: r for r in ranking.user_metrics(ranked, truth).collect()}
    assert set(rows) == {0, 1}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)  # four relevant items, three places
    assert rows[0].recall == 0.5 and rows[0].hit_rate == 1.0 and rows[0].ndcg == pytest.approx(dcg / ideal)
    assert (rows[1].recall, rows[1].hit_rate, rows[1].ndcg) == (0.0, 0.0, 0.0)


def test_metrics_without_eligible_users_are_zero(spark):
    ranked = spark.createDataFrame([], "user_idx bigint, item_idx bigint, rank int")
    none = spark.createDataFrame([], PAIRS)
    row = ranking.model_metrics({"mf": ranked}, {"test": none}, none, 3).first()
    assert (row.eligible_users, row.recall_at_20, row.ndcg_at_20) == (0, 0.0, 0.0)


METRICS = "model_name string, split string, eligible_users bigint, recall_at_20 double, ndcg_at_20 double, hit_rate_at_20 double"


def table(spark, recalls):
    rows = [(m, s, 5, r, 0.1, 0.2) for m, r in recalls.items() for s in ("validation", "test")]
    return spark.createDataFrame(rows, METRICS)


def test_winner_and_ties(spark):
    assert ranking.select_best_model(table(spark, {"learned": 0.3, "mf": 0.3, "popularity": 0.1})).first()[0] == "mf"
    assert ranking.select_best_model(table(spark, {"learned": 0.4, "mf": 0.3})).first()[0] == "learned"
    anchor = ranking.random_recall_anchor(table(spark, {"mf": 0.3}), 20, 200).first()
    assert anchor.random_recall_anchor == 0.1 and anchor.lift == pytest.approx(3.0)
    assert ranking.random_recall_anchor(table(spark, {"mf": 0.3}), 20, 0).first().lift is None


def test_recommender_gate(spark):
    good = table(spark, {"learned": 0.3, "mf": 0.4, "popularity": 0.1})
    topk = spark.createDataFrame([("u", 1, "i", 0.5, "mf")], "user_id string, rank int, item_id string, score double, model_name string")
    vectors = spark.createDataFrame([("i", 0, [0.1], "mf")], "item_id string, item_idx bigint, vector array<double>, model_name string")
    checks = validate.validate_recommender_outputs(ranking.select_best_model(good), good, topk, vectors)
    assert checks.count() == 7 and checks.filter("NOT passed").count() == 0
    bad = table(spark, {"mf": 1.4, "popularity": 0.1})
    broken = validate.validate_recommender_outputs(
        ranking.select_best_model(bad), bad, topk.limit(0), vectors.withColumn("model_name", F.lit("learned"))
    )
    failed = {r.check for r in broken.filter("NOT passed").collect()}
    assert failed == {
        "all_models_in_both_slices", "metrics_in_bounds", "topk_recommendations_non_empty",
        "topk_model_matches_selection", "embedding_table_matches_selection",
    }
    with pytest.raises(ValueError):
        validate.require_valid(broken)


def test_registered_metrics_hold_the_real_retrievers(spark):
    sf_dir, queries = "/root/testdata/sf0.001", registry.all_queries()
    real = {(r.model_name, r.split): r.recall_at_20 for r in queries["recommender_run_metrics"](spark, sf_dir).collect()}
    assert {name for name, _ in real} == {"popularity", "mf", "learned"} and len(real) == 6
    stand_in = {(r.model_name, r.split): r.recall_at_20 for r in queries["model_metrics"](spark, sf_dir).collect()}
    for split in ("validation", "test"):
        assert real["popularity", split] == stand_in["popularity", split]

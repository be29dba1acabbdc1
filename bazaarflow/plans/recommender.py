"""The recommender job: split, three retrievers, evaluation, winner, serving tables and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.scale import cut_lineage
from bazaarflow.operators import dq, ranking, retrieval, splits, validate
from bazaarflow.operators.embeddings import learned_retriever
from bazaarflow.schemas import EVALUATION_K


@dataclass
class RecommenderGold:
    split_rows: DataFrame
    user_index: DataFrame
    item_index: DataFrame
    pairs: DataFrame
    n_users: int
    n_items: int


@dataclass
class RecommenderRun:
    gold: RecommenderGold
    metrics: DataFrame
    selected: DataFrame
    model_name: str
    topk: DataFrame
    item_embeddings: DataFrame
    checks: DataFrame
    kpis: DataFrame


def build_gold(silver: DataFrame, min_date: str, max_date: str) -> RecommenderGold:
    """Split rows, index tables and the distinct train pairs, each written once and checked."""
    dq.require_passed(dq.dq_window_in_bounds(silver, min_date, max_date))
    rows = cut_lineage(splits.user_item_splits(splits.interaction_events(silver, min_date, max_date)))
    dq.require_passed(
        dq.dq_report(dq.dq_invalid_split(rows), dq.dq_split_chronology(rows), dq.dq_split_chronology_strict(rows))
    )
    users, items = splits.user_index(rows), splits.item_index(rows)
    pairs = cut_lineage(retrieval.positive_pairs(rows, users, items))
    return RecommenderGold(rows, users, items, pairs, users.count(), items.count())


def held_out(gold: RecommenderGold) -> dict[str, DataFrame]:
    return {
        name: ranking.held_out_truth(gold.split_rows, split, gold.user_index, gold.item_index)
        for name, split in ranking.HELD_OUT.items()
    }


def recommender_pipeline(
    silver: DataFrame,
    min_date: str,
    max_date: str,
    top_k: int = 20,
    components: int = 64,
    rank: int = 64,
    approximate: bool = False,
) -> RecommenderRun:
    """Train popularity, matrix factorization and the learned retriever, pick the best on validation, serve its top-k."""
    if top_k < 1:
        raise ValueError(f"a list needs at least one place, not {top_k}")
    gold = build_gold(silver, min_date, max_date)
    popularity = cut_lineage(retrieval.popularity_scores(gold.split_rows, gold.item_index))
    weighted = retrieval.tfidf_interactions(gold.pairs, gold.n_users)
    vectors = {
        "mf": retrieval.mf_factors(weighted, gold.n_users, gold.n_items, components),
        "learned": learned_retriever(gold.pairs, rank),
    }

    def lists(model: str, k: int, approx: bool = False) -> DataFrame:
        if model == "popularity":
            return retrieval.popularity_top_k(popularity, gold.user_index, gold.pairs, k)
        users, items = vectors[model]
        dim = items.select(F.max(F.size("vector"))).first()[0]
        everyone = retrieval.with_zero_vectors(gold.user_index, users, dim)
        search = retrieval.approx_top_k if approx else retrieval.embedding_top_k
        return search(everyone, items, gold.pairs, k)

    ranked = {model: cut_lineage(lists(model, EVALUATION_K)) for model in ("popularity", *vectors)}
    metrics = cut_lineage(ranking.model_metrics(ranked, held_out(gold), gold.pairs, gold.n_items))
    selected = ranking.select_best_model(metrics)
    winner = selected.first()["selected_model_name"]

    served = ranked[winner] if top_k == EVALUATION_K and not approximate else lists(winner, top_k, approximate)
    topk = cut_lineage(retrieval.topk_recommendations(winner, served, gold.user_index, gold.item_index))
    if winner == "popularity":
        factors = popularity.select("item_idx", F.array("score").alias("vector"))
    else:
        factors = vectors[winner][1]
    embeddings = retrieval.item_embedding_table(factors, gold.item_index, winner)
    checks = validate.validate_recommender_outputs(selected, metrics, topk, embeddings)
    anchored = ranking.random_recall_anchor(metrics, EVALUATION_K, gold.n_items)
    kpis = validate.interpretation_kpis(recommender=validate.recommender_kpis(anchored))
    return RecommenderRun(gold, metrics, selected, winner, topk, embeddings, checks, kpis)

"""Accuracy, retrieval, fairness and resampling statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_match, qids, support_f1, token_f1

ATTRIBUTES = ("gender", "geo_group")


def scored(predictions: DataFrame, compose: bool = True) -> DataFrame:
    """Predictions with a reference answer and their em and f1."""
    have = predictions.filter("gold_answer is not null")
    gold, answer = F.col("gold_answer"), F.coalesce("answer", F.lit(""))
    return have.withColumn("em", exact_match(answer, gold, compose)).withColumn("f1", token_f1(answer, gold, compose))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row."""
    return scored.agg(F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


def long_groups(scored: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """A10's basis: rows per attribute; a missing value is 'unknown'."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.lit("unknown")).alias("grp")) for a in attributes]))
    return scored.select("*", pairs.alias("x")).select("*", "x.attribute", "x.grp").drop("x")


def group_means(scored: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(attribute, grp, em, f1, n)."""
    return long_groups(scored, attributes).groupBy("attribute", "grp").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.count("*").alias("n"))


def gaps(means: DataFrame, column: str, name: str) -> DataFrame:
    """(attribute, name): largest minus smallest group value, 0 for one group."""
    gap = F.when(F.count("*") >= 2, F.max(column) - F.min(column)).otherwise(0.0)
    return means.groupBy("attribute").agg(F.round(gap, 6).alias(name))


def equalized_odds(scored: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(attribute, grp, tpr, n): the share of right answers of each group."""
    right = F.sum((F.col("em") == 1.0).cast("int"))
    return long_groups(scored, attributes).groupBy("attribute", "grp").agg(F.round(right / F.count("*"), 6).alias("tpr"), F.count("*").alias("n"))


def first_hit(ranked: Column, gold: Column, k: int) -> Column:
    """Reciprocal rank of the first hit among the first ``k``; 0 if there is none."""
    hits = F.transform(F.slice(ranked, 1, k), lambda c: F.array_contains(gold, c))
    at = F.array_position(hits, F.lit(True))
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def retrieval_metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, mrr, recall, precision) over rows (ranked, gold); rows without gold count
    nowhere, precision divides by what was retrieved."""
    have = rows.filter(F.size("gold") > 0).select("ranked", F.array_distinct("gold").alias("gold"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    top = F.slice("ranked", F.lit(1), F.col("k"))
    hits = F.size(F.array_intersect(top, F.col("gold")))
    at = F.array_position(F.transform(top, lambda c: F.array_contains(F.col("gold"), c)), F.lit(True))
    return have.groupBy("k").agg(
        F.round(F.avg(F.when(at > 0, 1.0 / at).otherwise(0.0)), 6).alias("mrr"),
        F.round(F.avg(hits / F.size("gold")), 6).alias("recall"),
        F.round(F.avg(F.when(F.size(top) > 0, hits / F.size(top)).otherwise(0.0)), 6).alias("precision"),
    )


def retrieval_fairness(rows: DataFrame, k: int = 5, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Mean reciprocal rank of each group; rows without gold count as 0."""
    with_rank = rows.withColumn("rr", first_hit(F.col("ranked"), F.col("gold"), k))
    return long_groups(with_rank, attributes).groupBy("attribute", "grp").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("n"))


def all_metrics(scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """(category, attribute, metric, value): accuracy, retrieval and fairness of ``scored`` predictions and ``ranked``
    lists in one long table."""

    def long(df: DataFrame, category: str, by: list[str]) -> DataFrame:
        values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in by])
        return df.select(F.lit(category).alias("category"), F.concat_ws(":", *by).alias("attribute"), F.explode(values).alias("x")).select("category", "attribute", "x.metric", "x.value")

    means = group_means(scored)
    rounded = means.select("attribute", "grp", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"), "n")
    return (
        long(accuracy(scored), "accuracy", [])
        .unionByName(long(retrieval_metrics(ranked), "retrieval", ["k"]))
        .unionByName(long(rounded, "fairness", ["attribute", "grp"]))
        .unionByName(long(gaps(means, "em", "parity_gap"), "parity", ["attribute"]))
        .unionByName(long(retrieval_fairness(ranked), "retrieval_fairness", ["attribute", "grp"]))
    )


def support_scores(predictions: DataFrame, records: DataFrame) -> DataFrame:
    """S8 over J1: mean F1 of the titles where both sides have some."""
    gold = records.select(F.col("_id").alias("id"), F.transform("supporting_facts", lambda x: x["title"]).alias("gold"))
    both = predictions.select("id", "supporting_titles").join(gold, "id").filter("size(supporting_titles) > 0 and size(gold) > 0")
    return both.agg(F.round(F.avg(support_f1(F.col("supporting_titles"), F.col("gold"))), 6).alias("support_f1"), F.count("*").alias("n"))


def first_demographics(rows: DataFrame, key: str, demographics: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """(key, gender, geo_group) of the first entity of ``entity_ids`` that has each.
    ``demographics``: (qid, gender, geo_group), one row each. The report variant (J17) also passes
    over the group 'unknown'."""
    at = rows.select(key, F.posexplode(qids(F.col("entity_ids"))).alias("at", "qid")).join(demographics, "qid")
    geo = F.when(F.col("geo_group") != "unknown", F.col("geo_group")) if skip_unknown else F.col("geo_group")
    ordered = at.withColumn("geo_group", geo)
    picked = ordered.groupBy(key).agg(
        F.min(F.when(F.col("gender") != "", F.struct("at", "gender")))["gender"].alias("gender"),
        F.min(F.when(F.col("geo_group") != "", F.struct("at", "geo_group")))["geo_group"].alias("geo_group"),
    )
    return rows.select(key).distinct().join(picked, key, "left")


#: Replicates whose draws one hash of a row holds: eight hex digits each for a weight, one for a sign.
_WEIGHTS, _SIGNS = 4, 32


def poisson_marks() -> list[str]:
    """Eight hex digits from which a draw is at least 1, 2, ...: the distribution of Poisson(1)."""
    marks, below, term = [], 0.0, math.exp(-1)
    for k in range(1, 12):
        below += term
        term /= k
        marks.append(f"{min(math.floor(below * 2**32), 2**32 - 1):08x}")
    return marks


def _replicas(rows: DataFrame, key: str, replicates: int, held: int, digits: int) -> DataFrame:
    """Rows times replicates, with ``digits`` hex digits that depend on replicate and row alone."""
    hashed = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // held))))
    hashed = hashed.withColumn("_hash", F.md5(F.concat_ws(":", F.col("_group").cast("string"), F.col(key).cast("string"))))
    each = hashed.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(held - 1))))
    out = each.withColumn("rep", F.col("_group") * held + F.col("_at")).withColumn("digits", F.substring("_hash", F.col("_at") * digits + 1, F.lit(digits)))
    return out.filter(F.col("rep") < replicates).drop("_group", "_hash", "_at")


def bootstrap_ci(scores: DataFrame, replicates: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(mean, lower, upper). ``scores``: (key, value), keys distinct. In replicate r a row counts as often as
    a Poisson(1) draw from the hash of (r, key) says, which is resampling with replacement as far as
    sums can tell; bounds are the sorted means at int(a/2 R) and int((1 - a/2) R) - 1.

    The draws need no neighbour, so rows are read once and leave each task as one sum a replicate.
    """
    drawn = _replicas(scores.filter("value is not null"), "key", replicates, _WEIGHTS, 8)
    weight = F.when(F.col("digits") < poisson_marks()[0], 0)
    for k, mark in enumerate(poisson_marks()[1:], 1):
        weight = weight.when(F.col("digits") < mark, k)
    weight = weight.otherwise(len(poisson_marks()))
    sums = drawn.select("rep", "value", weight.alias("w")).groupBy("rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("value")).alias("total"))
    means = sums.filter("n > 0").select("rep", F.round(F.col("total") / F.col("n"), 9).alias("m"))
    alpha = 1 - confidence
    lo, hi = int(alpha / 2 * replicates), int((1 - alpha / 2) * replicates) - 1
    rank = F.row_number().over(Window.orderBy("m", "rep")) - 1  # as many rows as replicates
    picked = means.withColumn("rank", rank).agg(
        F.max(F.when(F.col("rank") == lo, F.col("m"))).alias("lower"), F.max(F.when(F.col("rank") == hi, F.col("m"))).alias("upper")
    )
    mean = scores.agg(F.avg("value").alias("mean"))
    return mean.crossJoin(picked).select(*[F.round(F.coalesce(x, F.lit(0.0)), 6).alias(x) for x in ("mean", "lower", "upper")])


def permutation_test(pairs: DataFrame, replicates: int = 1000) -> DataFrame:
    """(observed, p_value, n). ``pairs``: (key, a, b), keys distinct. Replicate r swaps a pair where a
    hex digit of the hash of (r, key) is 8 or more; two-sided, hits over replicates."""
    drawn = _replicas(pairs.select("key", (F.col("a") - F.col("b")).alias("d")), "key", replicates, _SIGNS, 1)
    sums = drawn.groupBy("rep").agg((F.sum(F.when(F.col("digits") >= "8", -F.col("d")).otherwise(F.col("d"))) / F.count("*")).alias("m"))
    seen = pairs.agg(F.avg(F.col("a") - F.col("b")).alias("observed"), F.count("*").alias("n"))
    hits = F.avg((F.abs(F.round("m", 9)) >= F.abs(F.round("observed", 9))).cast("double"))
    return sums.crossJoin(F.broadcast(seen)).groupBy("observed", "n").agg(hits.alias("p_value")).select(F.round("observed", 6).alias("observed"), F.round("p_value", 6).alias("p_value"), "n")

import hashlib
import random

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunking, metrics


def groups(spark, counts, cap):
    sentences = [" ".join(["w"] * n) for n in counts]
    row = spark.createDataFrame([(sentences,)], "s array<string>")
    return [[len(x.split()) for x in g] for g in row.select(chunking.sentence_groups(F.col("s"), cap)).head()[0]]


def test_sentence_groups(spark):
    assert groups(spark, [3, 3, 9, 2], 5) == [[3], [3], [9], [2]]
    assert groups(spark, [2, 3, 4], 5) == [[2, 3], [4]]
    assert groups(spark, [2, 3], 5) == [[2, 3]]
    assert groups(spark, [], 5) == []


def test_chunk_corpus(spark):
    schema = "_id string, loaded_at timestamp, supporting_facts array<struct<title:string,sent_id:int>>, context array<struct<title:string,sentences:array<string>>>"
    at = dt.datetime(2025, 1, 1)
    rows = [
        ("q1", at, [("T/x", 0)], [("T/x", ["a b.", None, "c."]), ("U", None), ("V", [])]),
        ("q2", at, [], [("T/x", ["other"])]),
        ("q2", at + dt.timedelta(1), [], [("T/x", ["other"])]),
        ("q3", at, None, None),
    ]
    records = chunking.latest_records(spark.createDataFrame(rows, schema))
    assert records.count() == 3
    parts = chunking.paragraph_chunks(records)
    corpus = chunking.chunk_corpus(parts).collect()
    assert [(r.chunk_id, r.text, r.question_ids, r.is_supporting) for r in corpus] == [("doc_T_x_0", "a b. c.", ["q1", "q2"], True)]
    assert {(r.question_id, r.ord, r.chunk_id) for r in chunking.question_chunks(parts).collect()} == {("q1", 0, "doc_T_x_0"), ("q2", 0, "doc_T_x_0")}


def test_retrieval_metrics(spark):
    rows = spark.createDataFrame([(["p", "q", "r"], ["r"]), (["p", "q"], []), ([], ["z"])], "ranked array<string>, gold array<string>")
    got = {r.k: (r.mrr, r.recall, r.precision) for r in metrics.retrieval_metrics(rows, (2, 3)).collect()}
    assert got[2] == (0, 0, 0) and got[3] == (pytest.approx(1 / 6, abs=1e-6), 0.5, pytest.approx(1 / 6, abs=1e-6))
    one = spark.createDataFrame([(["p", "q"], ["p"])], "ranked array<string>, gold array<string>")
    assert metrics.retrieval_metrics(one, (5,)).head().precision == 0.5


def test_fairness_counts_empty_gold_as_zero(spark):
    rows = spark.createDataFrame([(["p"], ["p"], "m", None), (["p"], [], "m", "european")], "ranked array<string>, gold array<string>, gender string, geo_group string")
    got = {(r.attribute, r.grp): (r.mrr, r.n) for r in metrics.retrieval_fairness(rows).collect()}
    assert got == {("gender", "m"): (0.5, 2), ("geo_group", "unknown"): (1.0, 1), ("geo_group", "european"): (0.0, 1)}


def test_group_measures(spark):
    rows = spark.createDataFrame([("yes", "yes", "f", "x"), ("no", "yes", "m", "x"), ("yes", "yes", "m", "x"), ("a", None, "m", "x")], "answer string, gold_answer string, gender string, geo_group string")
    scored = metrics.scored(rows)
    assert metrics.accuracy(scored).head().n == 3
    means = metrics.group_means(scored)
    assert {r.attribute: r.gap for r in metrics.gaps(means, "em", "gap").collect()} == {"gender": 0.5, "geo_group": 0.0}
    assert {r.grp: r.tpr for r in metrics.equalized_odds(scored, ("gender",)).collect()} == {"f": 1.0, "m": 0.5}


def test_first_demographics(spark):
    people = spark.createDataFrame([("Q1", None, "unknown"), ("Q2", "male", "european")], "qid string, gender string, geo_group string")
    rows = spark.createDataFrame([(1, "Q1_Q2"), (2, "Q9"), (3, None)], "k long, entity_ids string")
    got = {r.k: (r.gender, r.geo_group) for r in metrics.first_demographics(rows, "k", people).collect()}
    assert got == {1: ("male", "unknown"), 2: (None, None), 3: (None, None)}
    assert metrics.first_demographics(rows, "k", people, skip_unknown=True).filter("k = 1").head().geo_group == "european"


def test_bootstrap_equals_plain_python(spark):
    values = [0.0, 1.0, 1.0, 0.0, 1.0, 0.5, 0.25]
    rows = spark.createDataFrame([*enumerate(values), (99, None)], "key long, value double")
    marks = metrics.poisson_marks()
    means = []
    for rep in range(200):
        digits = [hashlib.md5(f"{rep // 4}:{k}".encode()).hexdigest()[rep % 4 * 8 :][:8] for k in range(len(values))]
        weights = [sum(d >= m for m in marks) for d in digits]
        if sum(weights):
            means.append(round(sum(w * v for w, v in zip(weights, values)) / sum(weights), 9))
    means.sort()
    got = metrics.bootstrap_ci(rows, 200).head()
    assert (got.lower, got.upper) == (round(means[5], 6), round(means[194], 6)) and got.mean == round(sum(values) / len(values), 6)
    assert tuple(metrics.bootstrap_ci(rows.limit(0)).head()) == (0.0, 0.0, 0.0)


def test_bootstrap_has_width_and_covers(spark):
    """Of samples with a known mean nearly all intervals hold it, and they are as wide as theory says."""
    rnd = random.Random(5)
    n, share, held, widths = 400, 0.3, 0, []
    for sample in range(12):
        rows = spark.createDataFrame([(sample * n + i, float(rnd.random() < share)) for i in range(n)], "key long, value double")
        got = metrics.bootstrap_ci(rows).head()
        held += got.lower <= share <= got.upper
        widths.append(got.upper - got.lower)
        assert got.lower < got.mean < got.upper
    theory = 2 * 1.96 * (share * (1 - share) / n) ** 0.5
    assert held >= 10 and abs(sum(widths) / len(widths) / theory - 1) < 0.15


def test_permutation(spark):
    pairs = spark.createDataFrame([(i, 0.5, 0.5) for i in range(7)], "key long, a double, b double")
    assert metrics.permutation_test(pairs, 50).head().p_value == 1.0
    rnd = random.Random(6)
    same = spark.createDataFrame([(i, rnd.random(), rnd.random()) for i in range(200)], "key long, a double, b double")
    better = same.withColumn("a", F.col("a") + 0.3)
    assert metrics.permutation_test(same).head().p_value > 0.05 and metrics.permutation_test(better).head().p_value == 0.0

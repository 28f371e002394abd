"""Expansion over arrays: against the joins of a scorer of one's own, and what it leaves behind."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom import session
from sparkloom.functions.text import ngram_overlap
from sparkloom.operators import expand, filtering, graph, ranking

TRIPLE = "subject string, relation string, obj string, source_chunk_id string, confidence double"


@pytest.fixture(scope="module")
def hub(spark):
    """60 queries whose first chunk names a hub of 300 neighbours, most in a chunk of their own."""
    rnd = random.Random(4)
    rows = [("hub", "r", f"e{i:03}", f"c{i:03}", 1.0) for i in range(300)] + [(f"e{rnd.randint(0, 299):03}", "r", f"f{i:03}", f"d{i:03}", 1.0) for i in range(300)]
    triples = graph.clean_triples(spark.createDataFrame(rows, TRIPLE)).cache()
    chunks = sorted({r[3] for r in rows})
    seeds = spark.createDataFrame([(q, c, 1.0 / (k + 1)) for q in range(60) for k, c in enumerate(["c000", *rnd.sample(chunks, q % 7), f"none{q}"])], "query_id long, chunk_id string, score double").cache()
    tags = spark.createDataFrame([(c, rnd.choice(["f", "m", "unknown", None]), rnd.choice(["x", "y", "z"])) for c in chunks if rnd.random() < 0.8], "chunk_id string, gender string, geo_group string").cache()
    return triples, graph.mentions(triples), graph.undirected(triples), seeds, tags


@pytest.fixture
def left(monkeypatch):
    """Rows of the tables written."""
    rows = []

    def counted(df, write=session.written_at if hasattr(session, "written_at") else None):
        df, path = write(df) if write else (session.durable(df), "")
        rows.append(df.count())
        return df, path

    if hasattr(session, "written_at"):
        from sparkloom.operators import walk

        monkeypatch.setattr(session, "written_at", counted)
        monkeypatch.setattr(walk, "written_at", counted)
    else:
        for m in (session, expand):
            monkeypatch.setattr(m, "written", lambda df: counted(df)[0])
    return rows


def same(got, want):
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
    got, want = rows(got), rows(want)
    assert got == want and got


def by_joins(hub):
    """Whole expansion by joins: a scorer that changes nothing."""
    _, mentions, edges, seeds, _ = hub
    return expand.bfs(seeds, mentions, edges, adjust=lambda step, chunks: step)


LINKS = 2000  # more than the graph has of any kind


def test_f3_best_chunks(hub, left):
    _, mentions, edges, seeds, _ = hub
    got = expand.expand(seeds, mentions, edges, 20)
    assert max(left) < LINKS  # 60 queries times 300 names are 18,000 rows
    same(got, expand.ranked(by_joins(hub)[0], 20))


def test_f5_post_hoc(hub, left):
    _, mentions, edges, seeds, tags = hub
    got = expand.fair_expand(seeds, mentions, edges, tags, "post_hoc")
    assert max(left) < LINKS
    same(got, expand.post_hoc(by_joins(hub)[0], tags))


def test_f10_constraint(hub, left):
    _, mentions, edges, seeds, tags = hub
    got = expand.fair_expand(seeds, mentions, edges, tags, "constraint")
    assert max(left) < LINKS
    same(got, expand.constrained(by_joins(hub)[0], tags))


def test_f1_in_traversal_counts_every_chunk_found(hub, left):
    _, mentions, edges, seeds, tags = hub
    got = expand.fair_expand(seeds, mentions, edges, tags, "in_traversal")
    assert max(left) < LINKS
    whole, _ = expand.bfs(seeds, mentions, edges, adjust=expand.balance(tags, mentions))
    same(got, expand.ranked(whole.withColumn("score", F.round("score", 9)), 20))


def test_f8_entities(hub, left):
    _, mentions, edges, seeds, _ = hub
    rows = lambda df: sorted((r.query_id, r.entity, r.hop, round(r.score, 9)) for r in df.collect())
    got = rows(expand.bfs(seeds, mentions, edges)[1])
    assert max(left) < LINKS and len(got) > LINKS
    assert got == rows(by_joins(hub)[1])


def test_f8_scores_are_rounded_where_they_are_found(spark, hub):
    """Halves up, as by Spark, but each score of a query once: a BigDecimal for every row is slow."""
    _, mentions, edges, seeds, _ = hub
    odd = seeds.withColumn("score", F.col("score") / 1024)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, got = expand.bfs(odd, mentions, edges)[1], expand.bfs(odd, mentions, edges, places=9)[1]
    want = rows(whole.withColumn("score", F.round("score", 9)))
    assert rows(got) == want and (1 / 1024) in {r[2] for r in rows(whole)} and 0.000976563 in {r[2] for r in want}
    assert rows(expand.bfs(odd, mentions, edges, adjust=lambda step, chunks: step, places=9)[1]) == want


def test_f6_filter(hub, left):
    triples, mentions, edges, seeds, _ = hub
    top = expand.expand(seeds, mentions, edges, 20).drop("rank")
    asked = seeds.select("query_id", F.lit("who").alias("question")).distinct()
    got = {(r.query_id, r.chunk_id) for r in filtering.graph_filter(top, mentions, triples, asked, 20).collect()}
    assert max(left) < LINKS
    assert got == {(r.query_id, r.chunk_id) for r in top.collect() if not r.chunk_id.startswith("none")}


def weights(hub, **how):
    triples, mentions, _, seeds, _ = hub
    asked = seeds.select("query_id", F.lit("Does the HUB know e001 or E002?").alias("question")).distinct()
    return asked, filtering.expanded_weights(seeds, mentions, triples, asked, 20, **how)


def listed(df):
    return sorted((r.query_id, r.a, r.b, round(r.weight, 9)) for r in df.collect())


def test_f9_weights(hub, left):
    triples, mentions, _, _, _ = hub
    asked, got = weights(hub)
    got = listed(got)
    assert max(left) < LINKS
    chunks, entities = by_joins(hub)
    assert got == listed(filtering.edge_weights(expand.ranked(chunks, 20).drop("rank"), mentions, triples, entities, asked))


def test_f12_forest(hub, left):
    got = listed(weights(hub, only_forest=True)[1])
    assert max(left) < LINKS
    assert got == listed(filtering.spanning_forest(weights(hub)[1]))


def test_f2_f4_order(hub, left):
    """From the best chunk, neighbours by name."""
    triples, mentions, edges, seeds, _ = hub
    ordered = filtering.dfs_order(expand.expand(seeds, mentions, edges, 5).drop("rank"), mentions, triples)
    rows = sorted((r.query_id, r.place, r.chunk_id) for r in ordered.collect())
    assert max(left) < LINKS
    assert [p for q, p, _ in rows if q == 0] == [1, 2, 3, 4, 5]
    assert [c for q, _, c in rows if q == 0] == ["c000", "c001", "c002", "c003", "c004"]


def test_f7_f11_reranked_after_expansion(spark, hub, left):
    _, mentions, edges, seeds, _ = hub
    asked = seeds.select("query_id", F.lit("name c001").alias("question")).distinct()
    texts = mentions.select("chunk_id", F.concat(F.lit("name "), "chunk_id").alias("text")).distinct()
    best = ranking.rerank(expand.expand(seeds, mentions, edges, 20), asked, texts, 1).collect()
    assert max(left) < LINKS
    assert len(best) == 60 and sum(r.chunk_id == "c001" for r in best) > 30


def test_f7_overlap_of_a_long_text(spark):
    """Substrings by place made a text of 40,000 characters take minutes."""
    rows = spark.createDataFrame([("Green Apples ", "green apple "), ("a", ""), (None, "x"), ("Émile Zola", "émile zola " * 4000)], "q string, t string")
    began = time.time()
    long = rows.select(ranking.overlap(F.col("q"), F.col("t")).alias("s")).collect()
    assert time.time() - began < 20 and long[3].s > 0.5 and long[2].s is None
    assert [r.s for r in rows.limit(2).select(ngram_overlap(F.col("q"), F.col("t")).alias("s")).collect()] == [r.s for r in long[:2]]

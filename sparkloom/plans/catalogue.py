"""Queries over the driver's tables, one or more for each operator of the survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import pipeline
from ..config import load_config
from ..functions import text as S
from ..operators import chunking, expand, filtering, generation, graph, linking, metrics, ranking
from ..session import ensure_checkpoint_dir, written
from ..sources.tables import table as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Searches take as queries every row whose id is divisible by this, against all rows.
EVERY = 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- shared inputs ---------------------------------------------------------------------------------


def _records(s: SparkSession, d: str) -> DataFrame:
    return chunking.latest_records(T(s, d, "records"))


def _triples(s: SparkSession, d: str) -> DataFrame:
    return graph.clean_triples(T(s, d, "triples"))


def _people(s: SparkSession, d: str) -> DataFrame:
    """(qid, gender, geo_group): one row for each entity; blank values are none."""
    tidy = lambda c: F.lower(graph.stripped(c))
    rows = T(s, d, "demographics").select("qid", tidy("gender").alias("gender"), "geo_group")
    return rows.groupBy("qid").agg(F.min(F.when(F.col("gender") != "", F.col("gender"))).alias("gender"), F.min("geo_group").alias("geo_group"))


def _seeds(s: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """(query_id, chunk_id, score): retrieved chunks of the query set, by reciprocal position."""
    asked = T(s, d, "predictions").filter(F.col("pred_id") % every == 0)
    at = asked.select(F.col("pred_id").alias("query_id"), F.posexplode("retrieved_chunk_ids").alias("pos", "chunk_id"))
    return at.select("query_id", "chunk_id", (1.0 / (F.col("pos") + 1)).alias("score"))


def _questions(s: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    return T(s, d, "predictions").filter(F.col("pred_id") % every == 0).select(F.col("pred_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"))


def _tags(s: SparkSession, d: str) -> DataFrame:
    """(chunk_id, gender, geo_group) by the first entity of the chunk's questions that has each."""
    links = T(s, d, "chunks").select("chunk_id", F.explode("question_ids").alias("_id")).distinct()
    entity = _records(s, d).select("_id", F.explode(S.qids(F.col("entity_ids"))).alias("qid"))
    joined = links.join(entity, "_id").join(_people(s, d), "qid")
    pick = lambda c: F.min(F.when(F.col(c) != "", F.struct("qid", c)))[c].alias(c)
    return joined.groupBy("chunk_id").agg(pick("gender"), pick("geo_group"))


def _bfs(s: SparkSession, d: str, **how: object) -> tuple[DataFrame, DataFrame]:
    t = _triples(s, d)
    return expand.bfs(_seeds(s, d), graph.mentions(t), graph.undirected(t), **how)


def _best(s: SparkSession, d: str, k: int = expand.MAX_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, score): the best chunks of the expansion, written once for what follows."""
    return written(expand.ranked(_bfs(s, d, top=k)[0], k).drop("rank"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    """(chunk_id, text): the first text of each chunk id."""
    return T(s, d, "chunks").groupBy("chunk_id").agg(F.min_by("text", "chunk_row").alias("text")).filter("text is not null")


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Every prediction with a reference answer, scored."""
    return metrics.scored(T(s, d, "predictions"))


def _ranked_gold(s: SparkSession, d: str) -> DataFrame:
    """(pred_id, ranked, gold, gender, geo_group): gold chunk ids from the supporting titles (Q8)."""
    gold = _records(s, d).select(F.col("_id").alias("id"), F.transform(F.array_distinct(F.transform(F.coalesce("supporting_facts", F.array()), lambda x: x["title"])), S.gold_id).alias("gold"))
    p = T(s, d, "predictions").select("pred_id", "id", F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")).alias("ranked"), "gender", "geo_group")
    return p.join(gold, "id")


# --- records and scalar functions --------------------------------------------------------------------


@query
def records_parsed(s, d):
    """IO3, IO4, Q: one row a record with its sizes."""
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)).cast("long")
    return _records(s, d).select(
        "_id", F.coalesce("question_type", F.lit("")).alias("question_type"),
        F.greatest(F.size("supporting_facts"), F.lit(0)).cast("long").alias("n_supporting"),
        F.greatest(F.size(F.filter("evidences", lambda e: F.size(e) >= 3)), F.lit(0)).cast("long").alias("n_evidences"),
        F.greatest(F.size("context"), F.lit(0)).cast("long").alias("n_paragraphs"),
    )


@query
def record_qids(s, d):
    """P2."""
    return _records(s, d).select("_id", F.posexplode(S.qids(F.col("entity_ids"))).alias("pos", "qid")).select("_id", F.col("pos").cast("long"), "qid")


@query
def supporting_titles(s, d):
    """P3."""
    titles = F.array_distinct(F.transform("supporting_facts", lambda x: x["title"]))
    return _records(s, d).select("_id", F.explode(titles).alias("title"))


@query
def paragraph_text(s, d):
    """P1, S13."""
    p = _records(s, d).select("_id", F.posexplode("context").alias("pos", "p")).filter("p.sentences is not null")
    body = chunking.paragraph_text(F.col("p.sentences"))
    return p.select("_id", F.col("pos").cast("long"), F.length(body).cast("long").alias("n_chars"), S.word_count(body).cast("long").alias("n_words"))


@query
def evidence_triples(s, d):
    """P4."""
    return graph.evidence_triples(_records(s, d)).select("question_id", F.col("ord").cast("long"), "subject", "relation", "obj")


@query
def safe_ids(s, d):
    """S5, Q8."""
    return T(s, d, "chunks").select("chunk_row", S.safe_id(F.col("source_title")).alias("safe"), S.gold_id(F.col("source_title")).alias("gold"))


@query
def truncated_texts(s, d):
    """At 64 words."""
    t = T(s, d, "chunks")
    return t.select("chunk_row", F.md5(S.truncate_words(F.col("text"), 64)).alias("digest"), S.word_count(F.col("text")).cast("long").alias("n_words"))


@query
def parsed_answers(s, d):
    """S9."""
    p = T(s, d, "predictions")
    return p.select("pred_id", S.parse_answer(F.col("raw_response")).alias("parsed"))


@query
def rendered_prompts(s, d):
    """S16."""
    p = T(s, d, "predictions").select("pred_id", F.md5(S.render_prompt(F.coalesce("question", F.lit("")), F.coalesce("gold_answer", F.lit("")))).alias("digest"))
    return p


@query
def geo_classes(s, d):
    """S10, IO17."""
    return T(s, d, "demographics").groupBy(S.geo_group(F.col("country")).alias("computed"), "geo_group").agg(F.count("*").alias("n"))


@query
def answer_scores(s, d):
    """S1, S3, S6, S7, P12."""
    return _scored(s, d).select("pred_id", "em", F.round("f1", 6).alias("f1"))


@query
def text_hashes(s, d):
    """IO19: first 16 hex digits of SHA-256."""
    return T(s, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@query
def props_parsed(s, d):
    """IO1: JSON text to columns."""
    return T(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def uri_tails(s, d):
    """Codes from addresses, mapped to names."""
    uri = F.concat(F.lit("http://example.org/entity/"), F.when(F.col("qid").endswith("7"), "Q6581072").when(F.col("qid").endswith("1"), "Q6581097").otherwise(F.col("qid")))
    return T(s, d, "demographics").groupBy(S.gender_name(S.uri_tail(uri)).alias("gender")).agg(F.count("*").alias("n"))


# --- chunks --------------------------------------------------------------------------------------------


@query
def chunk_corpus(s, d):
    """T1, T2, A1, IO6, IO9."""
    c = chunking.chunk_corpus(chunking.paragraph_chunks(_records(s, d)))
    return c.select("chunk_id", "source_title", F.md5("text").alias("digest"), F.size("question_ids").cast("long").alias("n_questions"), "is_supporting")


@query
def question_chunks(s, d):
    """IO8, W9: chunks of every question in order."""
    return chunking.question_chunks(chunking.paragraph_chunks(_records(s, d)))


@query
def chunk_lookup(s, d):
    """IO8, J14: retrieved ids with a text, in order."""
    p = T(s, d, "predictions").select("pred_id", F.posexplode("retrieved_chunk_ids").alias("pos", "chunk_id"))
    return p.join(_texts(s, d), "chunk_id").groupBy("pred_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def linked_triples(s, d):
    """J4, SO5: counts of evidence triples by question and whether they have a chunk."""
    r = _records(s, d)
    linked = graph.linked_triples(graph.evidence_triples(r), chunking.question_chunks(chunking.paragraph_chunks(r)))
    return linked.groupBy("question_id").agg(F.count("*").alias("n"), F.countDistinct("source_chunk_id").alias("n_chunks"))


# --- graph ---------------------------------------------------------------------------------------------


@query
def triples_extract(s, d):
    """P4, P10, IO11."""
    return _triples(s, d).select("triple_id", "subject", "relation", "obj", "source_chunk_id")


@query
def kg_nodes(s, d):
    """KG1."""
    return graph.entities(_triples(s, d))


@query
def kg_related(s, d):
    """KG1, KG8, KG11, IO10."""
    return graph.related(_triples(s, d)).withColumnRenamed("obj", "object").groupBy("subject", "object").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("top"))


@query
def kg_mentions(s, d):
    """KG1."""
    return graph.mentions(_triples(s, d))


@query
def kg_summary(s, d):
    """A16-A18, KG13, IO13."""
    return graph.summary(_triples(s, d))


@query
def chunk_entities(s, d):
    """KG6, KG9, KG10, J7."""
    return graph.links_by_chunk(graph.mentions(_triples(s, d)))


@query
def entity_chunks(s, d):
    """KG5, KG9, KG10, J8: every link, with the number of the entity's."""
    return graph.links_by_entity(graph.mentions(_triples(s, d)))


def _starts(s, d):
    return T(s, d, "canonical_entities").filter(F.col("entity_id") % EVERY == 0).select(F.col("canonical_name").alias("start"))


@query
def neighbors_1hop(s, d):
    """KG2, KG3, J9."""
    return graph.neighbors(_starts(s, d), graph.undirected(_triples(s, d)), 1)


@query
def neighbors_2hop(s, d):
    """KG2, KG3, J10, SO6."""
    return graph.neighbors(_starts(s, d), graph.undirected(_triples(s, d)), 2)


@query
def induced_subgraph(s, d):
    """KG4: edges among canonical places and persons."""
    nodes = T(s, d, "canonical_entities").filter("kind in ('place', 'person')").select(F.col("canonical_name").alias("entity"))
    return graph.induced(_triples(s, d), nodes).select("subject", "relation", "obj", "source_chunk_id")


@query
def edges_between(s, d):
    """KG7: parallel edges of every ordered pair that has some."""
    t = _triples(s, d)
    pairs = t.groupBy("subject", "obj").agg(F.count("*").alias("n")).filter("n > 1").select("subject", "obj")
    return graph.edges_between(t, pairs).groupBy("subject", "obj").agg(F.count("*").alias("n"), F.countDistinct("relation").alias("n_relations"))


@query
def index_overlap(s, d):
    """Chunk ids of index and graph."""
    index, kg = T(s, d, "chunks").select("chunk_id").distinct(), graph.mentions(_triples(s, d)).select("chunk_id").distinct()
    a = index.agg(F.count("*").alias("n_index"))
    b = index.join(kg, "chunk_id", "left_semi").agg(F.count("*").alias("n_both"))
    return a.crossJoin(b).withColumn("share", F.round(S.safe_ratio(F.col("n_both"), F.col("n_index")), 6))


# --- linking -------------------------------------------------------------------------------------------


@query
def ngram_jaccard_pairs(s, d):
    """J12, S2, SO1: similar pairs of distinct lower-case names."""
    forms = linking.mention_counts(_triples(s, d)).select(F.lower(F.trim("name")).alias("form")).distinct()
    return linking.similar_pairs(forms).withColumn("similarity", F.round("similarity", 6))


@query
def entity_clusters(s, d):
    """T3, T4, A2, A3."""
    return linking.clusters(_triples(s, d))


@query
def cluster_count(s, d):
    """A4."""
    return linking.clusters(_triples(s, d)).agg(F.countDistinct("canonical").alias("n"))


@query
def normalised_triples(s, d):
    """P5, P6."""
    t = _triples(s, d)
    return linking.normalise(t, linking.clusters(t)).select("triple_id", "subject", "obj")


@query
def entity_to_qid(s, d):
    """J5, W9."""
    r = _records(s, d)
    return linking.entity_to_qid(r, graph.evidence_triples(r))


@query
def canonical_qids(s, d):
    """J6."""
    r = _records(s, d)
    e = graph.evidence_triples(r)
    return linking.canonical_qids(linking.entity_to_qid(r, e), linking.clusters(e))


@query
def chunk_demographics(s, d):
    """J3 over the records' own graph."""
    r = _records(s, d)
    e = graph.evidence_triples(r)
    linked = graph.linked_triples(e, chunking.question_chunks(chunking.paragraph_chunks(r)))
    return linking.chunk_demographics(graph.mentions(linked), linking.entity_to_qid(r, e), _people(s, d))


@query
def prediction_demographics(s, d):
    """J2."""
    return metrics.first_demographics(T(s, d, "predictions").select("pred_id", "entity_ids"), "pred_id", _people(s, d))


@query
def question_demographics(s, d):
    """J17."""
    return metrics.first_demographics(_records(s, d).select("_id", "entity_ids"), "_id", _people(s, d), skip_unknown=True)


@query
def demographics_coverage(s, d):
    """A20, IO16."""
    return _people(s, d).agg(F.count("*").alias("n"), F.count("gender").alias("with_gender"), F.count("geo_group").alias("with_geo"))


@query
def sample_priority(s, d):
    """The first 100 records, those with demographics first."""
    r = _records(s, d)
    known = r.select("_id", F.explode(S.qids(F.col("entity_ids"))).alias("qid")).join(_people(s, d), "qid")
    has = known.groupBy("_id").agg(F.bool_or(F.col("gender").isNotNull() | F.coalesce(F.col("geo_group") != "unknown", F.lit(False))).alias("has_demo"))
    order = [F.desc("has_demo"), "loaded_at", "_id"]
    return r.join(has, "_id", "left").withColumn("has_demo", F.coalesce("has_demo", F.lit(False))).orderBy(*order).limit(100).select("_id", "has_demo")


# --- retrieval -----------------------------------------------------------------------------------------


@query
def dense_topk(s, d):
    """R2, P7."""
    v = T(s, d, "embeddings")
    return ranking.dense_topk(v.filter(F.col("vec_id") % EVERY == 0), v, 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _dense_hits(s, d):
    """(query_id, label, ranked labels): hits are rows of the query's label."""
    v = T(s, d, "embeddings")
    label = v.select("vec_id", "label")
    top = ranking.dense_topk(v.filter(F.col("vec_id") % EVERY == 0), v, 10).join(label, "vec_id")
    q = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hits = top.join(q, "query_id").select("query_id", "rank", (F.col("label") == F.col("wanted")).cast("int").alias("hit"), "wanted")
    size = label.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n_gold"))
    return hits.join(size, "wanted")


@query
def dense_sweep(s, d):
    """Mean reciprocal rank, recall and precision at 1, 3, 5, 10 by label."""
    h = _dense_hits(s, d).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10))))).filter("rank <= k")
    per = h.groupBy("query_id", "k", "n_gold").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    return per.groupBy("k").agg(
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.try_divide("hits", "n_gold")), 6).alias("recall"),
        F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("precision"),
    )


@query
def bm25_topk(s, d):
    """R3, R4, W4, P8."""
    docs = T(s, d, "chunks").select(F.col("chunk_row").alias("doc_id"), "text").filter("text is not null")
    return ranking.bm25_topk(_questions(s, d).withColumnRenamed("question", "text"), docs)


@query
def embedded_texts(s, d):
    """R1, IO18: stub encoder over every chunk text."""
    return ranking.embed(_texts(s, d)).select("chunk_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query
def bfs_expand_chunks(s, d):
    """R5, R6, W1, A5."""
    return expand.ranked(_bfs(s, d, top=expand.MAX_CHUNKS)[0], expand.MAX_CHUNKS).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@query
def bfs_expand_entities(s, d):
    """R5, R7, Q1."""
    return _bfs(s, d, places=9)[1].select("query_id", "entity", "score", "hop")


def _fair(s, d, strategy):
    """R9."""
    t = _triples(s, d)
    out = expand.fair_expand(_seeds(s, d), graph.mentions(t), graph.undirected(t), _tags(s, d), strategy)
    return out.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@query
def fair_post_hoc(s, d):
    """R8-R10, W5."""
    return _fair(s, d, "post_hoc")


@query
def fair_in_traversal(s, d):
    """R8, R9, R11, R13."""
    return _fair(s, d, "in_traversal")


@query
def fair_constraint(s, d):
    """R9, R12, W6, Q6."""
    return _fair(s, d, "constraint")


@query
def graph_filtered(s, d):
    """R14, J11, J13, W2, Q2."""
    t = _triples(s, d)
    top = _best(s, d)
    return filtering.graph_filter(top, graph.mentions(t), t, _questions(s, d)).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@query
def edge_weights(s, d):
    """R15, SO3."""
    return _weights(s, d)


def _weights(s, d, every=EVERY, only_forest=False):
    t = _triples(s, d)
    return filtering.expanded_weights(_seeds(s, d, every), graph.mentions(t), t, _questions(s, d, every), expand.MAX_CHUNKS, only_forest)


@query
def spanning_forest(s, d):
    """Edges and weight of the maximum forest of every prediction's question."""
    f = _weights(s, d, every=1, only_forest=True)
    return f.groupBy("query_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def dfs_contexts(s, d):
    """R17, R18."""
    t = _triples(s, d)
    top = _best(s, d, 5)
    ordered = filtering.dfs_order(top, graph.mentions(t), t)
    return filtering.organize(ordered, _texts(s, d)).select("query_id", F.md5("context").alias("digest"), S.word_count(F.col("context")).alias("n_words"))


@query
def reranked(s, d):
    """Stub scorer."""
    top = _best(s, d)
    return ranking.rerank(top, _questions(s, d), _texts(s, d))


@query
def generated_answers(s, d):
    """Stub model over organised contexts, for every prediction's question."""
    t = _triples(s, d)
    ordered = filtering.expanded_order(_seeds(s, d, every=1), graph.mentions(t), t, 5)
    rows = _questions(s, d, every=1).join(filtering.organize(ordered, _texts(s, d)), "query_id", "left")
    return generation.generate(rows).select("query_id", "answer")


@query
def retrieval_sizes(s, d):
    """Mean list sizes of the four stages over all questions."""
    t = _triples(s, d)
    m, questions = graph.mentions(t), _questions(s, d)
    expanded = _best(s, d)
    filtered = written(filtering.graph_filter(expanded, m, t, questions))
    final = ranking.rerank(filtered, questions, _texts(s, d))
    sizes = questions.agg(F.count("*").alias("n"))
    for name, rows in (("seed", _seeds(s, d)), ("expanded", expanded), ("filtered", filtered), ("final", final)):
        sizes = sizes.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    return sizes.select(*[F.round(F.col(c) / F.col("n"), 6).alias(c) for c in ("seed", "expanded", "filtered", "final")])


# --- evaluation ----------------------------------------------------------------------------------------


@query
def accuracy_summary(s, d):
    """A11, J1, P11."""
    return metrics.accuracy(_scored(s, d))


@query
def support_summary(s, d):
    """S8, SO2."""
    return metrics.support_scores(T(s, d, "predictions"), _records(s, d))


@query
def group_disparity(s, d):
    """A6, A10, SO4."""
    return metrics.group_means(_scored(s, d)).select("attribute", "grp", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"), "n")


@query
def demographic_parity(s, d):
    """A7."""
    return metrics.gaps(metrics.group_means(_scored(s, d)), "em", "parity_gap")


@query
def equalized_odds(s, d):
    """A8."""
    return metrics.equalized_odds(_scored(s, d))


@query
def retrieval_sweep(s, d):
    """A12-A15."""
    return metrics.retrieval_metrics(_ranked_gold(s, d))


@query
def retrieval_fairness(s, d):
    """A9."""
    return metrics.retrieval_fairness(_ranked_gold(s, d))


@query
def bootstrap_ci(s, d):
    """Of exact match."""
    return metrics.bootstrap_ci(_scored(s, d).select(F.col("pred_id").alias("key"), F.col("em").alias("value")))


def _two_runs(s, d):
    """The alphabetically first and last run, by question."""
    p = _scored(s, d).groupBy("experiment", "id").agg(F.min_by("answer", "pred_id").alias("answer"), F.min_by("f1", "pred_id").alias("f1"))
    ends = p.agg(F.min("experiment").alias("first"), F.max("experiment").alias("last"))
    marked = p.crossJoin(F.broadcast(ends))
    a = marked.filter("experiment = first").select("id", F.col("answer").alias("answer_a"), F.col("f1").alias("a"))
    b = marked.filter("experiment = last").select("id", F.col("answer").alias("answer_b"), F.col("f1").alias("b"))
    return a.join(b, "id")


@query
def permutation_test(s, d):
    """E2, E11."""
    return metrics.permutation_test(_two_runs(s, d).select(F.col("id").alias("key"), "a", "b"))


@query
def evaluate_all(s, d):
    """One long table of all metrics."""
    return metrics.all_metrics(_scored(s, d), _ranked_gold(s, d))


@query
def pipeline_end_to_end(s, d):
    """All seven stages over the 100 sampled questions of W8, with stub models; the table of metrics."""
    sc = s.sparkContext
    ensure_checkpoint_dir(s)
    out = f"{sc._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    settings = load_config("fair", [f"paths.records={d}/records.parquet", f"paths.demographics={d}/demographics.parquet", f"paths.output_dir={out}", "dataset.max_samples=100", "logging.level=ERROR", "logging.to_file=false"])
    results = pipeline.run_pipeline(s, settings)
    failed = [r for r in results.values() if r.status == "failed"]
    if failed:
        raise RuntimeError(f"{failed[0].stage}: {failed[0].message}")
    return pipeline.Run(s, settings).table("metrics")


# --- reports -------------------------------------------------------------------------------------------


@query
def corpus_stats(s, d):
    """A21."""
    r = records_parsed(s, d)
    return r.agg(F.count("*").alias("n"), F.round(F.avg("n_paragraphs"), 6).alias("paragraphs"), F.round(F.avg("n_evidences"), 6).alias("evidences"), F.round(F.avg((F.col("n_supporting") > 0).cast("double")), 6).alias("supported"))


@query
def value_share(s, d):
    """Group shares with nulls and whether one dominates."""
    p = T(s, d, "predictions").groupBy("gender").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return p.select("gender", "n", F.round(share, 6).alias("share"), F.when(share < 0.85, "OK").otherwise("SKEWED").alias("state"))


@query
def evidence_by_type(s, d):
    """A23."""
    return records_parsed(s, d).groupBy("question_type").agg(F.round(F.avg((F.col("n_evidences") > 0).cast("double")), 6).alias("share"), F.count("*").alias("n"))


@query
def crosstab_margins(s, d):
    """A24."""
    p = T(s, d, "predictions").select(F.coalesce("gender", F.lit("none")).alias("gender"), F.coalesce("geo_group", F.lit("none")).alias("geo_group"))
    c = p.cube("gender", "geo_group").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("gender", F.lit("All")).alias("gender"), F.coalesce("geo_group", F.lit("All")).alias("geo_group"), "n")


@query
def pivot_counts(s, d):
    """A25."""
    p = T(s, d, "predictions").withColumn("geo", F.coalesce("geo_group", F.lit("none")))
    return p.groupBy("experiment").pivot("geo", ["european", "non_european", "unknown", "none"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def relation_counts(s, d):
    """The 20 most frequent relations."""
    t = T(s, d, "triples").groupBy(F.coalesce("relation", F.lit("unknown")).alias("relation")).agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "relation").limit(20)


@query
def confidence_histogram(s, d):
    """30 bins of equal width."""
    t = T(s, d, "triples").filter("confidence is not null").select("confidence")
    ends = t.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    b = F.least(F.lit(29), F.floor((F.col("confidence") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30)).cast("long")
    return t.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query
def melted_metrics(s, d):
    """A28."""
    per = _scored(s, d).groupBy("experiment").agg(F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"))
    return per.unpivot(["experiment"], ["em", "f1"], "metric", "value")


@query
def type_breakdown(s, d):
    """Per type and run."""
    p = _scored(s, d).withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    return p.groupBy("question_type", "experiment").agg(F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


def _run_gaps(s, d):
    long = metrics.long_groups(_scored(s, d))
    means = long.groupBy("experiment", "attribute", "grp").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))
    gap = lambda c: F.when(F.count("*") >= 2, F.max(c) - F.min(c)).otherwise(0.0)
    return means.groupBy("experiment", "attribute").agg(gap("em").alias("parity"), gap("f1").alias("disparity"))


@query
def run_comparison(s, d):
    """Runs by attribute, wide, missing as 0."""
    wide = _run_gaps(s, d).groupBy("experiment").pivot("attribute", ["gender", "geo_group"]).agg(F.round(F.max("parity"), 6).alias("parity"), F.round(F.max("disparity"), 6).alias("disparity"))
    return wide.na.fill(0.0)


@query
def fairness_tradeoff(s, d):
    """F1 and largest parity gap of each run."""
    f1 = _scored(s, d).groupBy("experiment").agg(F.round(F.avg("f1"), 6).alias("f1"))
    return f1.join(_run_gaps(s, d).groupBy("experiment").agg(F.round(F.max("parity"), 6).alias("parity")), "experiment")


@query
def accuracy_listing(s, d):
    """Value and count keys of the long table paired."""
    e = evaluate_all(s, d).filter("category = 'fairness'")
    em, n = e.filter("metric = 'em'").select("attribute", F.col("value").alias("em")), e.filter("metric = 'n'").select("attribute", F.col("value").alias("n"))
    return em.join(n, "attribute")


@query
def changed_answers(s, d):
    """A34, J15."""
    return _two_runs(s, d).agg(F.count("*").alias("n"), F.sum((~F.col("answer_a").eqNullSafe(F.col("answer_b"))).cast("long")).alias("changed"))


@query
def first_per_type(s, d):
    """W12."""
    r = _records(s, d).withColumn("question_type", F.coalesce("question_type", F.lit("")))
    return r.groupBy("question_type").agg(F.min_by("_id", F.struct("loaded_at", "_id")).alias("_id"))


@query
def random_three(s, d):
    """Three rows by the hash of their id."""
    p = T(s, d, "predictions").select("pred_id", F.md5(F.concat(F.lit("42:"), F.col("pred_id").cast("string"))).alias("h"))
    return p.orderBy("h").limit(3)

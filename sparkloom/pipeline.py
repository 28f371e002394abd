"""From question records to evaluated answers in seven stages (R20, R21, E5-E10, IO20-IO22).

Each stage reads the tables of those before it and writes its own, so a run that was stopped goes on where it
stopped: a stage whose tables are whole is skipped. ``retrieve`` is one plan over all questions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as S
from .logs import run_logger
from .operators import chunking, expand, filtering, generation, graph, linking, metrics, ranking
from .session import ship_package, written
from .sources import files


class Stage(IntEnum):
    PREPROCESS = 1
    BUILD_KG = 2
    DEMOGRAPHICS = 3
    INDEX = 4
    RETRIEVE = 5
    GENERATE = 6
    EVALUATE = 7


@dataclass
class StageResult:
    stage: str
    status: str = "completed"
    duration_s: float = 0.0
    artifacts: dict[str, str] = field(default_factory=dict)
    message: str = ""


@dataclass
class Models:
    """What answers for the models: an encoder of texts, a scorer of (question, text), a generator of answers."""

    encode: Callable | None = None
    score: Callable | None = None
    generate: Callable = generation.first_words


class Run:
    """Settings and tables of one run; ``split`` names the tables of the corpus, the experiment those of its answers."""

    def __init__(self, spark: SparkSession, settings: dict, models: Models | None = None) -> None:
        self.spark, self.settings, self.models = spark, settings, models or Models()
        self.out = settings["paths"]["output_dir"]
        self.split = settings["dataset"]["split"]
        self.experiment = settings.get("experiment", {}).get("name", "default")
        ship_package(spark)

    def path(self, name: str) -> str:
        own = name in ("retrieval", "predictions", "metrics", "per_question")
        return f"{self.out}/{self.split}_{self.experiment}_{name}" if own else f"{self.out}/{self.split}_{name}"

    def table(self, name: str) -> DataFrame:
        return files.load(self.spark, self.path(name))

    def records(self) -> DataFrame:
        return chunking.latest_records(files.read_records(self.spark, self.settings["paths"]["records"]))


def run_preprocess(run: Run) -> dict[str, DataFrame]:
    """T1, T2, IO6."""
    chunks = written(chunking.paragraph_chunks(run.records(), run.settings["chunking"]["max_tokens"]))
    return {"chunks": chunking.chunk_corpus(chunks), "question_chunks": chunking.question_chunks(chunks)}


def run_build_kg(run: Run) -> dict[str, DataFrame]:
    """IO22, P4, J4, T3, P5, KG1, J5, J6: triples of canonical names, linked to the chunks of their questions."""
    records = run.records()
    evidence = written(graph.evidence_triples(records))
    names = written(linking.clusters(evidence))
    linked = linking.normalise(graph.linked_triples(evidence, run.table("question_chunks")), names)
    triples = linked.select("subject", "relation", "obj", "source_chunk_id", F.lit(1.0).alias("confidence")).distinct()
    return {"triples": triples, "entity_to_qid": linking.canonical_qids(linking.entity_to_qid(records, evidence), names)}


def run_demographics(run: Run) -> dict[str, DataFrame]:
    """IO16, IO17, A20: one row for each entity of the questions that the source knows."""
    wanted = run.records().select(F.explode(S.qids(F.col("entity_ids"))).alias("qid")).distinct()
    known = run.spark.read.parquet(run.settings["paths"]["demographics"]).join(wanted, "qid", "left_semi")
    tidy = lambda c: F.when(graph.stripped(c) != "", F.lower(graph.stripped(c)))
    return {"demographics": known.groupBy("qid").agg(F.min(tidy("gender")).alias("gender"), F.min("geo_group").alias("geo_group"))}


def run_index(run: Run) -> dict[str, DataFrame]:
    """R1, IO18, E6."""
    vectors = ranking.embed(run.table("chunks").filter("text is not null"), run.models.encode)
    return {"index": vectors.select(F.monotonically_increasing_id().alias("vec_id"), "chunk_id", "embedding")}


def questions(run: Run) -> DataFrame:
    """(query_id, id, question): all records, or the first ``max_samples``, those with demographics first."""
    records, most = run.records(), run.settings["dataset"].get("max_samples")
    if most:
        known = records.select("_id", F.explode(S.qids(F.col("entity_ids"))).alias("qid")).join(run.table("demographics"), "qid")
        has = known.groupBy("_id").agg(F.bool_or(F.col("gender").isNotNull() | F.coalesce(F.col("geo_group") != "unknown", F.lit(False))).alias("has"))
        records = records.join(has, "_id", "left").orderBy(F.desc(F.coalesce("has", F.lit(False))), "loaded_at", "_id").limit(most)
    # numbers below those of the index, so that no question is taken for the chunk of its number
    return written(records.select((-1 - F.monotonically_increasing_id()).alias("query_id"), F.col("_id").alias("id"), F.coalesce("question", F.lit("")).alias("question")))


def retrieve(run: Run, asked: DataFrame) -> DataFrame:
    """(query_id, context, retrieved_chunk_ids, num_seed, num_expanded, num_filtered, num_final, context_length)."""
    cfg = run.settings["retrieval"]
    index, texts = run.table("index"), run.table("chunks").select("chunk_id", "text").filter("text is not null")
    vectors = ranking.embed(asked.select(F.col("query_id").cast("string").alias("chunk_id"), F.col("question").alias("text")), run.models.encode)
    wanted = vectors.select(F.col("chunk_id").cast("long").alias("vec_id"), "embedding")
    hits = ranking.dense_topk(wanted, index, cfg["dense"]["top_k"])
    seed = written(hits.join(index.select("vec_id", "chunk_id"), "vec_id").select("query_id", "chunk_id", "score"))
    triples = run.table("triples")
    mentions, edges = graph.mentions(triples), graph.undirected(triples)
    how = cfg["expansion"]
    expanded, entities = seed, None
    if how["enabled"]:
        search = {"max_hops": how["max_hops"], "decay": how["score_decay"]}
        if how["fair"]:
            tags = linking.chunk_demographics(mentions, run.table("entity_to_qid"), run.table("demographics"))
            expanded = expand.fair_expand(seed, mentions, edges, written(tags), how["strategy"], how["max_chunks"], **search)
        else:
            expanded = expand.expand(seed, mentions, edges, how["max_chunks"], **search)
        expanded = written(expanded.select("query_id", "chunk_id", "score"))
    filtered = expanded
    if cfg["filter"]["enabled"]:
        filtered = written(filtering.graph_filter(expanded, mentions, triples, asked.select("query_id", "question"), cfg["filter"]["max_chunks"]).select("query_id", "chunk_id", "score"))
    final = filtered
    if cfg["reranker"]["enabled"]:
        final = written(ranking.rerank(filtered, asked.select("query_id", "question"), texts, cfg["reranker"]["top_k"], run.models.score).select("query_id", "chunk_id", "score"))
    if cfg["context"]["organize"]:
        ordered = filtering.dfs_order(final, mentions, triples)
    else:
        ordered = expand.ranked(final).withColumnRenamed("rank", "place")
    contexts = filtering.organize(ordered, texts, cfg["context"]["max_words"])
    listed = expand.ranked(final).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"))
    out = asked.join(contexts, "query_id", "left").join(listed, "query_id", "left")
    for name, rows in (("seed", seed), ("expanded", expanded), ("filtered", filtered), ("final", final)):
        out = out.join(rows.groupBy("query_id").agg(F.count("*").alias(f"num_{name}")), "query_id", "left")
    filled = out.na.fill(0, [f"num_{x}" for x in ("seed", "expanded", "filtered", "final")]).withColumn("context", F.coalesce("context", F.lit("")))
    return filled.withColumn("retrieved_chunk_ids", F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>"))).withColumn("context_length", S.word_count(F.col("context")))


def run_retrieve(run: Run) -> dict[str, DataFrame]:
    """R20, R21, E7, IO21."""
    return {"retrieval": retrieve(run, questions(run))}


def run_generate(run: Run) -> dict[str, DataFrame]:
    """Predictions with the columns that the evaluation reads."""
    rows = run.table("retrieval")
    answered = generation.generate(rows.select(F.col("id").alias("query_id"), "question", "context"), run.models.generate).withColumnRenamed("query_id", "id")
    gold = run.records().select(
        F.col("_id").alias("id"), F.col("answer").alias("gold_answer"), "question_type", "entity_ids",
        F.array_distinct(F.transform(F.coalesce("supporting_facts", F.array()), lambda x: x["title"])).alias("supporting_titles"),
    )
    return {"predictions": answered.select("id", "answer", "raw_response").join(rows.select("id", "question", "retrieved_chunk_ids"), "id").join(gold, "id")}


def run_evaluate(run: Run) -> dict[str, DataFrame]:
    """The long table of metrics, and the scores of each question."""
    plain = run.table("predictions").withColumn("pred_id", F.xxhash64("id")).withColumn("experiment", F.lit(run.experiment))
    groups = metrics.first_demographics(plain.select("id", "entity_ids"), "id", run.table("demographics"))
    predictions = written(plain.join(groups, "id"))
    scored = written(metrics.scored(predictions))
    gold = predictions.select("id", F.col("retrieved_chunk_ids").alias("ranked"), F.transform("supporting_titles", S.gold_id).alias("gold"), "gender", "geo_group")
    return {"metrics": metrics.all_metrics(scored, gold), "per_question": scored.select("id", "question", "answer", "gold_answer", "em", "f1", "gender", "geo_group")}


RUNNERS: dict[Stage, tuple[Callable[[Run], dict[str, DataFrame]], tuple[str, ...]]] = {
    Stage.PREPROCESS: (run_preprocess, ("chunks", "question_chunks")),
    Stage.BUILD_KG: (run_build_kg, ("triples", "entity_to_qid")),
    Stage.DEMOGRAPHICS: (run_demographics, ("demographics",)),
    Stage.INDEX: (run_index, ("index",)),
    Stage.RETRIEVE: (run_retrieve, ("retrieval",)),
    Stage.GENERATE: (run_generate, ("predictions",)),
    Stage.EVALUATE: (run_evaluate, ("metrics", "per_question")),
}


def run_stage(run: Run, stage: Stage, force: bool = False) -> StageResult:
    """Run one stage unless its tables are there; what it writes is whole or not there."""
    runner, names = RUNNERS[stage]
    result = StageResult(stage.name)
    if not force and all(files.exists(run.spark, run.path(n)) for n in names):
        result.status, result.message = "skipped", "tables are there"
    else:
        for name, df in runner(run).items():
            files.save(df, run.path(name))
        result.message = ", ".join(f"{n}: {run.table(n).count()} rows" for n in names)
    result.artifacts = {n: files.artifact_hash(run.spark, run.path(n)) for n in names}
    return result


def run_pipeline(
    spark: SparkSession, settings: dict, start_from: Stage | None = None, only: Stage | None = None, models: Models | None = None, force: bool = False
) -> dict[str, StageResult]:
    """The stages in order, each timed and entered in the manifest when it ends; a failure halts the run. The next
    run goes on from there."""
    run = Run(spark, settings, models)
    cfg = settings.get("logging", {})
    logger = run_logger(f"{run.experiment}_{run.split}", cfg.get("level", "INFO"), f"{run.out}/logs" if cfg.get("to_file") else None)
    book = f"{run.out}/pipeline_manifest.json"
    manifest = files.read_manifest(spark, book)
    results: dict[str, StageResult] = {}
    began = time.perf_counter()
    logger.info("run %s of split %s", run.experiment, run.split)
    for stage in Stage:
        if only is not None and stage != only or start_from is not None and stage < start_from:
            continue
        at = time.perf_counter()
        try:
            result = run_stage(run, stage, force or start_from is not None or only is not None)
        except Exception as error:
            logger.exception("stage %s failed", stage.name)
            result = StageResult(stage.name, "failed", message=str(error).splitlines()[0] if str(error) else type(error).__name__)
        result.duration_s = round(time.perf_counter() - at, 2)
        results[stage.name] = result
        logger.info("%d/%d %s %s in %.2f s: %s", stage, len(Stage), stage.name, result.status, result.duration_s, result.message)
        entry = {"status": result.status, "duration_s": result.duration_s, "artifacts": result.artifacts, "message": result.message, "timestamp": datetime.now(UTC).isoformat()}
        manifest.setdefault("stages", {})[stage.name] = entry
        files.write_manifest(spark, book, manifest)
        if result.status == "failed":
            break
    manifest["last_run"] = {
        "experiment": run.experiment, "split": run.split, "total_duration_s": round(time.perf_counter() - began, 2), "timestamp": datetime.now(UTC).isoformat(),
        "stages": {k: {"status": v.status, "duration_s": v.duration_s, "message": v.message} for k, v in results.items()},
    }
    files.write_manifest(spark, book, manifest)
    return results

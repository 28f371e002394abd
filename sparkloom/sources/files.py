"""JSON files, corpora, graphs and vector indexes as folders (IO1-IO22)."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gender_name, geo_group, uri_tail

#: Question records as they are published: positional arrays of mixed kinds are read as text.
RECORD_JSON = (
    "_id string, question string, answer string, type string, entity_ids string,"
    " supporting_facts array<array<string>>, evidences array<array<string>>, context array<array<string>>"
)
TRIPLE_JSON = "subject string, relation string, object string, obj string, source_chunk_id string, confidence string"
BATCH, RETRIES = 50, 3


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO1: one JSON array (or lines) with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """IO2: lines of JSON, overwritten."""
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """IO3, IO4, IO5: the records table from a parquet table or a JSON file that was put in place; missing keys
    become empty."""
    if str(path).endswith(".parquet"):
        return spark.read.parquet(path)
    raw = read_json(spark, path, RECORD_JSON)
    facts = F.transform(F.coalesce("supporting_facts", F.array()), lambda x: F.struct(F.get(x, 0).alias("title"), F.get(x, 1).try_cast("int").alias("sent_id")))
    context = F.transform(F.coalesce("context", F.array()), lambda x: F.struct(F.get(x, 0).alias("title"), F.from_json(F.get(x, 1), "array<string>").alias("sentences")))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return raw.select(
        "_id", text("question"), text("answer"), F.coalesce("type", F.lit("")).alias("question_type"), text("entity_ids"),
        facts.alias("supporting_facts"), F.filter(F.coalesce("evidences", F.array()), lambda e: F.size(e) >= 3).alias("evidences"), context.alias("context"),
        F.lit(None).cast("timestamp_ntz").alias("loaded_at"),
    )


def import_triples(spark: SparkSession, path: str) -> DataFrame:
    """IO11: triples from JSON with ``object`` or ``obj``, blanks cut off, confidence 1 if absent or no number."""
    raw = read_json(spark, path, TRIPLE_JSON)
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = raw.select(
        trimmed(F.col("subject")).alias("subject"), trimmed(F.col("relation")).alias("relation"), trimmed(F.coalesce("object", "obj")).alias("obj"),
        trimmed(F.col("source_chunk_id")).alias("source_chunk_id"), F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(1.0)).alias("confidence"),
    )
    return rows.filter("subject <> '' and relation <> '' and obj <> ''")


def save(df: DataFrame, path: str) -> None:
    """IO6, IO13, IO18, IO21: a table as parquet, overwritten."""
    df.write.mode("overwrite").parquet(str(path))


def load(spark: SparkSession, path: str) -> DataFrame:
    """IO7, IO14, IO18."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no such table: {path}")
    return spark.read.parquet(str(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def save_graph(triples: DataFrame, mentions: DataFrame, summary: DataFrame, path: str) -> None:
    """IO12-IO14: edges, mentions and the summary of a graph; clearing is overwriting (KG12)."""
    save(triples, f"{path}/related")
    save(mentions, f"{path}/mentions")
    write_json(summary, f"{path}/summary")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO14: (triples, mentions)."""
    return load(spark, f"{path}/related"), load(spark, f"{path}/mentions")


def artifact_hash(spark: SparkSession, path: str) -> str:
    """IO19: first 16 hex digits over the hashes of a table's files, in order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(str(path))
    hashes = sorted((r[0].rsplit("/", 1)[-1].split("-")[1], r[1]) for r in files.select("path", F.sha2("content", 256)).toLocalIterator())
    return hashlib.sha256("".join(h for _, h in hashes).encode()).hexdigest()[:16]


Transport = Callable[[str], list[dict]]


def demographics_request(qids: Iterable[str]) -> str:
    """IO15: the request for one batch of entities, both properties optional. Fixed: the property numbers."""
    values = " ".join(f"wd:{q}" for q in qids)
    return (
        "SELECT ?item ?itemLabel ?gender ?countryLabel WHERE { VALUES ?item { " + values + " } OPTIONAL { ?item wdt:P21 ?gender . }"
        ' OPTIONAL { ?item wdt:P27 ?country . } SERVICE wikibase:label { bd:serviceParam wikibase:language "en" . } }'
    )


def fetch_demographics(qids: DataFrame, transport: Transport, pause: float = 1.0, batch: int = BATCH) -> DataFrame:
    """IO15-IO17: (qid, label, gender, country, geo_group) of ``qids`` (qid), asked for in batches by ``transport``, which
    takes a request and returns bindings {name: value}; an answer that fails is tried again after 1, 2, ... times
    ``pause`` seconds and then left out. Of several bindings of an entity the last one stays; entities
    without any have no row."""

    def ask(request: str) -> list[dict]:
        for n in range(RETRIES):
            try:
                return transport(request)
            except OSError:
                if n + 1 < RETRIES:
                    time.sleep(pause * 2**n)
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column("qid").to_pylist()
            for k in range(0, len(ids), batch):
                rows = ask(demographics_request(ids[k : k + batch]))
                columns = [[r.get(c) for r in rows] for c in ("item", "itemLabel", "gender", "countryLabel")]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array(range(len(rows)), pa.int64())], names=["item", "label", "gender", "country", "at"])

    found = qids.select("qid").filter("qid is not null").distinct().mapInArrow(run, "item string, label string, gender string, country string, at long")
    last = found.groupBy(uri_tail(F.col("item")).alias("qid")).agg(F.max_by(F.struct("label", "gender", "country"), "at").alias("r"))
    gender = F.when(F.col("r.gender").isNotNull(), gender_name(uri_tail(F.col("r.gender"))))
    return last.select("qid", F.coalesce("r.label", "qid").alias("label"), gender.alias("gender"), F.col("r.country").alias("country"), geo_group(F.col("r.country")).alias("geo_group"))


def read_manifest(spark: SparkSession, path: str) -> dict:
    """IO20; {} where there is none. In the file system of the path, wherever the driver runs."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return {}
    return json.loads(spark.read.text(str(path), wholetext=True).head()[0])


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """IO20: written beside the old one first, so that a stop in between leaves a whole one."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, new = jvm.Path(str(path)), jvm.Path(f"{path}.new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(manifest, indent=2, ensure_ascii=False).encode()))
    stream.close()
    fs.delete(target, False)
    fs.rename(new, target)

"""Exact vector search and BM25.

Both take a bounded set of queries, which passes through the driver in blocks, against any number of rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import widen, written
from .walk import grams

#: Query vectors in one broadcast block, and numbers in one block of products.
QUERY_BLOCK, PRODUCTS = 4096, 4_000_000
K1, B = 1.5, 0.75


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """R2: (query_id, rank, vec_id, score): exact inner product in double precision, the query's
    own row left out. Queries go out in blocks of bounded size; each task keeps its best ``k`` of
    each query, so the shuffle holds k rows a task and query."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    out = spark.createDataFrame([], schema)
    block: list = []

    def against(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            best_score, best_id = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                all_v = flat.reshape(batch.num_rows, -1)
                step = max(k, PRODUCTS // max(1, len(q)))
                for s in range(0, batch.num_rows, step):
                    v_ids = all_ids[s : s + step]
                    scores = q @ all_v[s : s + step].T
                    scores[q_ids[:, None] == v_ids[None, :]] = -np.inf
                    merged = np.concatenate([best_score, scores], axis=1)
                    m_ids = np.concatenate([best_id, np.broadcast_to(v_ids, scores.shape)], axis=1)
                    order = np.lexsort((m_ids, -merged), axis=1)[:, :k]
                    best_score, best_id = np.take_along_axis(merged, order, 1), np.take_along_axis(m_ids, order, 1)
            at = np.flatnonzero((best_id >= 0).ravel() & np.isfinite(best_score.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, k)[at]), pa.array(best_id.ravel()[at]), pa.array(best_score.ravel()[at])], names=["query_id", "vec_id", "score"]
            )

        return vectors.select("vec_id", "embedding").filter("embedding is not null").mapInArrow(run, schema)

    for r in queries.select("vec_id", "embedding").filter("embedding is not null").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(against(block)), []
    if block:
        out = out.unionByName(against(block))
    score = F.round("score", 9)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def terms(text: Column) -> Column:
    """Words in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score). ``queries``: (query_id, text), ``docs``:
    (doc_id, text). Okapi scores; terms in more than half of the documents get a quarter of the
    mean idf. The k best are taken, of which those above zero stay.

    A document is one row, so its terms need no shuffle: only the document counts of terms are grouped, partial
    first. Queries go out in blocks of bounded size; each task scores its documents against a block as
    a sparse product and keeps the best ``k`` of each query, so the shuffle holds k rows a task and query
    even for a word that every document and query has.
    """
    spark = docs.sparkSession
    words = docs.select("doc_id", terms(F.col("text")).alias("w"))
    n, avgdl = words.agg(F.count("*"), F.avg(F.size("w"))).head()
    schema = "query_id long, doc_id long, score double"
    out = spark.createDataFrame([], schema)
    if not n:
        return out.withColumn("rank", F.lit(1)).select("query_id", "rank", "doc_id", "score")
    counts = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = written(counts.withColumn("idf", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)))
    mean_idf = raw.agg(F.avg("idf")).head()[0]

    def against(block: list[tuple[int, list[str]]]) -> DataFrame:
        asked = sorted({t for _, ts in block for t in ts})
        idf = spark.createDataFrame([(t,) for t in asked], "term string").join(raw, "term")
        known = {r["term"]: r["idf"] if r["idf"] >= 0 else 0.25 * mean_idf for r in idf.toLocalIterator()}
        number = {t: i for i, t in enumerate(known)}
        pairs = sorted((number[t], q, c) for q, (_, ts) in enumerate(block) for t, c in Counter(ts).items() if t in number)
        at, q, c = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), list(number), np.array([known[t] for t in number]), at, q, c))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, names, idfs, at, asking, times = shared.value
            first = np.searchsorted(at, np.arange(len(names) + 1))
            names = pa.array(names, pa.string())
            best_score, best_id = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), -1, np.int64)
            step = max(k, PRODUCTS // max(1, len(q_ids)))
            for batch in batches:
                for s in range(0, batch.num_rows, step):
                    part = batch.slice(s, step)
                    lists, ids = part.column("w"), part.column("doc_id").to_numpy(zero_copy_only=False)
                    sizes = np.diff(lists.offsets.to_numpy())
                    found = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
                    rows = np.repeat(np.arange(len(ids)), sizes)[found >= 0]
                    key, tf = np.unique(rows * len(names) + found[found >= 0], return_counts=True)
                    row, term = np.divmod(key, max(1, len(names)))
                    weight = idfs[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / avgdl))
                    # every posting meets the queries that have its term
                    n_asking = first[term + 1] - first[term]
                    of = np.repeat(np.arange(len(term)), n_asking)
                    hit = np.repeat(first[term] - (np.cumsum(n_asking) - n_asking), n_asking) + np.arange(n_asking.sum())
                    flat = np.bincount(asking[hit] * len(ids) + row[of], weights=weight[of] * times[hit], minlength=len(q_ids) * len(ids))
                    scores = np.round(flat.reshape(len(q_ids), len(ids)), 6)
                    merged = np.concatenate([best_score, np.where(scores > 0, scores, -np.inf)], axis=1)
                    m_ids = np.concatenate([best_id, np.broadcast_to(ids, scores.shape)], axis=1)
                    # the k-th best score bounds what has to be sorted
                    cut = np.partition(merged, -k, axis=1)[:, -k]
                    for i in np.flatnonzero(np.isfinite(merged.max(axis=1))):
                        some = np.flatnonzero((merged[i] >= cut[i]) & np.isfinite(merged[i]))
                        some = some[np.lexsort((m_ids[i, some], -merged[i, some]))[:k]]
                        best_score[i], best_id[i] = -np.inf, -1
                        best_score[i, : len(some)], best_id[i, : len(some)] = merged[i, some], m_ids[i, some]
            at_best = np.flatnonzero(np.isfinite(best_score.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, k)[at_best]), pa.array(best_id.ravel()[at_best]), pa.array(best_score.ravel()[at_best])], names=["query_id", "doc_id", "score"]
            )

        return widen(words).mapInArrow(run, schema)

    block: list[tuple[int, list[str]]] = []
    for r in queries.select("query_id", terms(F.col("text")).alias("w")).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(against(block)), []
    if block:
        out = out.unionByName(against(block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def hashing_encoder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """R1's stand-in for a sentence model: hashed words, unit length. A stub: it knows no language."""

    def encode(texts: pd.Series) -> pd.Series:
        import zlib

        def one(text: str | None) -> list[float]:
            v = np.zeros(dim, np.float32)
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return encode


def embed(texts: DataFrame, encode: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(chunk_id, embedding) by a pluggable encoder of whole batches."""
    encode = encode or hashing_encoder()
    udf = F.pandas_udf(lambda s: encode(s), "array<float>")
    return texts.select("chunk_id", udf("text").alias("embedding"))


@F.pandas_udf(DoubleType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ngram_overlap`` of texts in lower case, in time that grows with a text's length, not with its square."""
    out = [None if x is None or y is None else len(g & h) / len(g | h) for x, y in zip(a, b) for g, h in [(grams(x or ""), grams(y or ""))]]
    return pd.Series(out, dtype="float64")


def overlap(question: Column, text: Column) -> Column:
    return _overlap(F.lower(F.trim(question)), F.lower(F.trim(text)))


def rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rescored candidates, at most ``k``. The default scorer is a stub: n-gram overlap of
    question and text."""
    score = (scorer or overlap)(F.col("question"), F.col("text"))
    joined = candidates.select("query_id", "chunk_id").join(queries, "query_id").join(texts, "chunk_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return joined.select("query_id", "chunk_id", F.round(score, 9).alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)

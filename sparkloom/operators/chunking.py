"""Sentence chunking and the chunk corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_id, word_count

MAX_TOKENS = 512


def latest_records(records: DataFrame) -> DataFrame:
    """One row for each ``_id``: a record that was sent twice counts once (its last row; one without a time comes before all others)."""
    others = [c for c in records.columns if c != "_id"]
    last = records.groupBy("_id").agg(F.max_by(F.struct(*others), F.struct("loaded_at")).alias("r"))
    return last.select("_id", *[F.col(f"r.{c}").alias(c) for c in others])


def paragraph_text(sentences: Column) -> Column:
    """Sentences joined by one blank; null ones are left out."""
    return F.array_join(sentences, " ")


def sentence_groups(sentences: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """array<array<string>>, the sentences of each chunk. A fold over the sentences: a chunk is
    closed before the sentence that would pass the limit; an oversized sentence stands alone."""
    kept = F.filter(sentences, lambda s: s.isNotNull())
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n")
    )

    def step(acc: Column, s: Column) -> Column:
        n = word_count(s)
        full = (F.size(acc["open"]) > 0) & (acc["n"] + n > max_tokens)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(acc["open"], F.array(s))).alias("open"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    whole = word_count(F.array_join(kept, " ")) <= max_tokens
    folded = F.aggregate(kept, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.when(F.size(kept) == 0, F.array().cast("array<array<string>>")).when(whole, F.array(kept)).otherwise(folded)


def paragraph_chunks(records: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(question_id, para_no, idx, chunk_id, source_title, text, supports): chunks of each record's
    paragraphs in order. Takes ``latest_records``."""
    titles = F.transform(F.coalesce("supporting_facts", F.array()), lambda x: x["title"])
    paras = records.select(F.col("_id").alias("question_id"), titles.alias("titles"), F.posexplode("context").alias("para_no", "p"))
    groups = paras.filter("p.sentences is not null").select(
        "question_id", "para_no", "titles", F.col("p.title").alias("source_title"), F.posexplode(sentence_groups(F.col("p.sentences"), max_tokens)).alias("idx", "sentences")
    )
    return groups.select(
        "question_id", "para_no", "idx",
        F.concat(F.lit("doc_"), safe_id(F.coalesce("source_title", F.lit(""))), F.lit("_"), F.col("idx")).alias("chunk_id"),
        "source_title",
        F.array_join("sentences", " ").alias("text"),
        F.coalesce(F.array_contains("titles", F.col("source_title")), F.lit(False)).alias("supports"),
    )


def chunk_corpus(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id: first text by (question, paragraph), sorted distinct
    questions, whether any of them is supported. A chunk that very many questions share keeps a
    list of as many ids; all else is aggregated before the shuffle."""
    order = F.struct("question_id", "para_no", "idx")
    return chunks.groupBy("chunk_id").agg(
        F.min_by("source_title", order).alias("source_title"),
        F.min_by("text", order).alias("text"),
        F.array_sort(F.collect_set("question_id")).alias("question_ids"),
        F.bool_or("supports").alias("is_supporting"),
    )


def question_chunks(chunks: DataFrame) -> DataFrame:
    """(question_id, ord, chunk_id): a question's distinct chunks in order of appearance."""
    first = chunks.groupBy("question_id", "chunk_id").agg(F.min(F.struct("para_no", "idx")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("at", "chunk_id")) - 1
    return first.select("question_id", rank.alias("ord"), "chunk_id")

"""Queries of this subpackage, by problem, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import widen
from ..sources.tables import table
from . import canonical, formdups, leak, pack, pairs, quota, residue, split

ITEM = ["item_kind", "item_key", "para_no", "sent_no"]


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over the limit, a record sent twice still giving its items twice."""
    records = table(spark, sf_dir, "records").select("_id", "context")
    chunks = table(spark, sf_dir, "chunks").select("chunk_row", "text")
    return split.record_items(records, split.MAX_WORDS).unionByName(split.chunk_items(chunks, split.MAX_WORDS))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the splitter cuts into more than one piece for their number of words."""
    pieces = split.split_items(_oversized(spark, sf_dir))
    return pieces.filter(f"piece_no = 1 and item_words > {split.MAX_WORDS}").select(*ITEM).distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized items, once for a record that was sent twice."""
    items = _oversized(spark, sf_dir).dropDuplicates(ITEM)
    return split.split_items(items).drop("item_words")


_FORMS = {"chunks": ("chunk_row", ["source_title", "text"]), "chunk_payloads": ("payload_id", ["source_title", "section", "text", "lang"])}


def _forms(spark: SparkSession, sf_dir: str, operator: Callable[..., DataFrame]) -> DataFrame:
    chunks = operator(table(spark, sf_dir, "chunks"), *_FORMS["chunks"])
    payloads = operator(formdups.payload_fields(table(spark, sf_dir, "chunk_payloads")), *_FORMS["chunk_payloads"])
    return chunks.withColumn("source_table", F.lit("chunks")).unionByName(payloads.withColumn("source_table", F.lit("chunk_payloads")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that is a copy of one with a smaller id."""
    return _forms(spark, sf_dir, formdups.form_copies).select("source_table", "kept_id", "copy_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different record with its number of copies."""
    return _forms(spark, sf_dir, formdups.form_counts).select("source_table", "kept_id", "n_copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that too few distinct entities exist for."""
    return quota.impossible_targets(table(spark, sf_dir, "demographics"), table(spark, sf_dir, "sample_targets"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement, supply, quota and shortfall of every target."""
    return quota.quota_report(table(spark, sf_dir, "demographics"), table(spark, sf_dir, "sample_targets"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn samples of all plans."""
    return quota.quota_sample(table(spark, sf_dir, "demographics"), table(spark, sf_dir, "sample_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective replies with their defect."""
    return pairs.defects(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values with the entry that they denote, or 0."""
    return p5_slips(spark, sf_dir).select("triple_id", "field_name", "entity_id")


def p5_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values with the entry that they denote and the slips in them."""
    return canonical.denoted(table(spark, sf_dir, "triples").select("triple_id", "subject", "obj"), table(spark, sf_dir, "canonical_entities"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing gives more than one container."""
    return p6_containers(spark, sf_dir).filter("n_containers > 1").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size and container."""
    return pack.pack(table(spark, sf_dir, "documents"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused space of the packing."""
    return pack.unused(p6_containers(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote a test item, with the item."""
    return p7_passages(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote a test item, with the longest passage's words and edits."""
    return leak.leaks(widen(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are residue or hold a placeholder."""
    return residue.residue_docs(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of residue in every document that has any."""
    return residue.residue_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_counts, p3_found, p3_report, p3_sample, p4_found, p5_found, p5_slips, p6_found, p6_containers, p6_unused, p7_found, p7_passages, p8_found, p8_report)
}

"""Queries of the operators that prepare text for training language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.group_split import mixed_sets, split_shares, stratified_group_split
from ticketloom.llm.language import detect_languages, label_defects
from ticketloom.llm.mixing import mix, shares
from ticketloom.llm.overlap import cross_split_pairs
from ticketloom.llm.pairs import broken_pairs
from ticketloom.llm.queries_sql import ORACLES  # noqa: F401
from ticketloom.llm.residue import residue, without_residue
from ticketloom.llm.setjoin import near_groups
from ticketloom.llm.splitting import split_oversized
from ticketloom.llm.tokens import encode


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """record_id, set_id of tied records whose set has no single semantic group id."""
    return mixed_sets(_table(spark, sf, "customer_it_support_prepared"))


def p1_split(spark: SparkSession, sf: str) -> DataFrame:
    """record_id, set_id, label, split of every prepared record."""
    return stratified_group_split(_table(spark, sf, "customer_it_support_prepared"))


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached, per split and priority."""
    return split_shares(p1_split(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """record_id, group_id of every prepared record in a group of two or more near records."""
    return near_groups(_table(spark, sf, "customer_it_support_prepared"))


def p5_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """record_id_a, record_id_b, jaccard and overlaps of near pairs across training and evaluation."""
    return cross_split_pairs(_table(spark, sf, "customer_it_support_prepared"), _table(spark, sf, "split_assignments"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_overlaps(spark, sf).select("record_id_a", "record_id_b")


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs and touched evaluation records per split and version of the evaluation record."""
    pairs = p5_overlaps(spark, sf)
    splits = _table(spark, sf, "split_assignments").where("source_row_id is not null and split in ('validation', 'holdout')").select("source_row_id", "split").distinct()
    version = _table(spark, sf, "aa_dataset_tickets").where("source_row_id is not null").groupBy("source_row_id").agg(F.min("version").alias("version"))
    of = _table(spark, sf, "customer_it_support_prepared").select("record_id", "source_row_id").join(splits, "source_row_id").join(version, "source_row_id", "left").select(F.col("record_id").alias("e"), "split", "version")
    ends = pairs.select(F.explode(F.array("record_id_a", "record_id_b")).alias("e"))
    return ends.join(of, "e").groupBy("split", "version").agg(F.count("*").alias("pairs"), F.countDistinct("e").alias("eval_records"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """source_row_id and defect of tickets without a usable answer, those with template residue left out."""
    tickets = _table(spark, sf, "aa_dataset_tickets")
    return broken_pairs(tickets, _table(spark, sf, "language_audit")).join(residue(tickets).select("source_row_id").distinct(), "source_row_id", "left_anti")


def p4_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every ticket's body, by stretch."""
    return detect_languages(_table(spark, sf, "aa_dataset_tickets"), _table(spark, sf, "language_audit"), _table(spark, sf, "language_label_manual_review"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """source_row_id, segment_no, lang of tickets with a missing or wrong label or a mixed body."""
    cases = label_defects(p4_languages(spark, sf)).select("source_row_id", "segment_no", "lang")
    return cases.join(p6_found(spark, sf).select("source_row_id").distinct(), "source_row_id", "left_anti")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """source_row_id and field of template residue, filler and error pages."""
    return residue(_table(spark, sf, "aa_dataset_tickets"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The tickets without such a field."""
    tickets = _table(spark, sf, "aa_dataset_tickets")
    return without_residue(tickets, residue(tickets))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the list of ids of its text."""
    return encode(_table(spark, sf, "documents"))


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Uses per document of a listed source, at the largest total that meets the shares."""
    return mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share per listed source."""
    return shares(p8_uses(spark, sf), _table(spark, sf, "mix_targets"))


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every document, in order."""
    return split_oversized(_table(spark, sf, "documents"), _table(spark, sf, "size_limits"))


QUERIES = {"p1_found": p1_found, "p1_split": p1_split, "p1_shares": p1_shares, "p2_found": p2_found, "p5_found": p5_found, "p5_overlaps": p5_overlaps, "p5_counts": p5_counts, "p3_found": p3_found, "p4_languages": p4_languages, "p4_found": p4_found, "p6_found": p6_found, "p6_clean": p6_clean, "p7_ids": p7_ids, "p8_uses": p8_uses, "p8_shares": p8_shares, "p9_pieces": p9_pieces}

"""Queries of this subpackage for ``__spark_entry__``: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import matching, names, nearest, neardup, packing, residue, survivor, tokens, venues


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.field_survivors(table(spark, folder, "ingest_records"), table(spark, folder, "source_list"), table(spark, folder, "venue_list"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_pairs(table(spark, folder, "papers"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_works(table(spark, folder, "papers"), table(spark, folder, "s2_records")).select("arxiv_id", "rec_id")


def p3_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_works(table(spark, folder, "papers"), table(spark, folder, "s2_records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.neighbour_pairs(table(spark, folder, "papers"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_pairs(table(spark, folder, "papers"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.class_links(table(spark, folder, "papers"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return venues.map_venues(table(spark, folder, "ingest_records"), table(spark, folder, "venue_list"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.encode_column(table(spark, folder, "documents"), sizes_only=True))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_confidence, p4_found, p5_found, p5_classes, p6_found, p7_ids, p8_containers, p9_found)}

"""Queries of the training-text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import encodings, leaks, linkage, markup, names, packing, representative, scans, turns
from brindle.llm.sql import SQL  # noqa: F401
from brindle.session import read


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return turns.speaker_turns(read(spark, root, "audio_asset")).select("audio_id", "turn_no", "speaker")


def p1_turns(spark: SparkSession, root: str) -> DataFrame:
    return turns.speaker_turns(read(spark, root, "audio_asset"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return representative.opinion_survivors(read(spark, root, "opinion_text"))


def p2_merged(spark: SparkSession, root: str) -> DataFrame:
    return representative.merged_opinions(read(spark, root, "opinion_text"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.noise(read(spark, root, "image_asset"))


def p3_pages(spark: SparkSession, root: str) -> DataFrame:
    return scans.clean_documents(read(spark, root, "image_asset"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return linkage.matches(read(spark, root, "proceeding"), read(spark, root, "raw_proceeding")).select("proceeding_id", "raw_id")


def p5_matches(spark: SparkSession, root: str) -> DataFrame:
    return linkage.matches(read(spark, root, "proceeding"), read(spark, root, "raw_proceeding"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.found(read(spark, root, "text_asset"))


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    return markup.cleaned(read(spark, root, "text_asset")).select("text_id", "family", "marked", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return names.linked_pairs(read(spark, root, "person"))


def p7_entities(spark: SparkSession, root: str) -> DataFrame:
    return names.resolve(read(spark, root, "person"))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(read(spark, root, "documents"), read(spark, root, "pack_capacity"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fills(p8_packed(spark, root), read(spark, root, "pack_capacity"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(read(spark, root, "documents"), read(spark, root, "benchmark")).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return encodings.restored(read(spark, root, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, root: str) -> DataFrame:
    return encodings.restored(read(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_turns, p2_found, p2_merged, p3_found, p3_pages, p5_found, p5_matches, p6_found, p6_clean, p7_found, p7_entities, p8_packed, p8_fill, p9_found, p10_found, p10_restored)}

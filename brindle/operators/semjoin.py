"""Semantic join: pairs of rows that may match, from blocking on rare shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.retrieve import words


def blocked_join(left: DataFrame, right: DataFrame, lf: Column, rf: Column, lkey: str, rkey: str, top_k: int, most_common: float = 0.1) -> DataFrame:
    """(lkey, rkey, shared): for each left row the top_k right rows that share most words, counting
    words of at most `most_common` of the right rows; a left row that shares those with fewer than top_k
    right rows counts all its words. Words meet as keys of an equi-join."""
    l = left.select(F.col(f"`{lkey}`").alias("l"), F.explode(words(lf)).alias("w")).distinct()
    r = right.select(F.col(f"`{rkey}`").alias("r"), F.explode(words(rf)).alias("w")).distinct()
    # only words of the left side matter; the narrower side goes first
    r = r.join(l.select("w").distinct(), "w", "left_semi")
    n = right.count()
    counts = r.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rare = counts.where(F.col("n") <= max(1.0, most_common * n)).select("w")
    some = l.join(rare, "w").join(r, "w").groupBy("l", "r").agg(F.count(F.lit(1)).alias("shared"))
    enough = some.groupBy("l").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top_k).select("l")
    every = l.join(enough, "l", "left_anti").join(r, "w").groupBy("l", "r").agg(F.count(F.lit(1)).alias("shared"))
    shared = some.join(enough, "l", "left_semi").unionByName(every)
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("shared"), "r"))
    return shared.withColumn("_rank", rank).where(F.col("_rank") <= top_k).select(F.col("l").alias(lkey), F.col("r").alias(rkey), "shared")

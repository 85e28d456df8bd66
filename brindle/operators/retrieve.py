"""Top-k retrieval: by vectors, by shared words, and in tiers. Ties go by key, so results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.judge import keywords, phrase


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a fixed vector; null for a null, empty or zero vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    size = sum(x * x for x in query) ** 0.5
    return F.when((norm > 0) & (F.size(v) == len(query)) & F.lit(size > 0), dot / norm / F.lit(size or 1.0))


def nearest(df: DataFrame, vector: Column, query: list[float], k: int, keys: list[Column]) -> DataFrame:
    """The k rows most similar to the query. A top-k of each partition goes to the driver, no sort."""
    return df.withColumn("score", cosine(vector, query)).where("score is not null").orderBy(F.desc("score"), *keys).limit(k)


def words(body: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(body), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))


def token_overlap(df: DataFrame, body: Column, text: str, k: int, keys: list[Column]) -> DataFrame:
    """The k rows that share most words with the text."""
    want = sorted({w.lower() for w in keywords(text, 64)})
    score = F.size(F.array_intersect(words(body), F.array(*map(F.lit, want)))) if want else F.lit(0)
    return df.withColumn("score", score.cast("double")).where("score > 0").orderBy(F.desc("score"), *keys).limit(k)


def tiers(df: DataFrame, body: Column, text: str, pool: int, keys: list[Column]) -> DataFrame:
    """Rows with the whole phrase, then with all keywords, with any, and all others; up to `pool` rows."""
    low, said, kws = F.lower(body), phrase(text).lower(), [w.lower() for w in keywords(text)]
    has = [F.contains(low, F.lit(w)) for w in kws] or [F.lit(False)]
    every, some = has[0], has[0]
    for h in has[1:]:
        every, some = every & h, some | h
    whole = F.contains(low, F.lit(said)) if " " in said else F.lit(False)
    tier = F.when(whole, 0).when(every, 1).when(some, 2).otherwise(3)
    return df.withColumn("tier", tier).orderBy("tier", *keys).limit(pool)

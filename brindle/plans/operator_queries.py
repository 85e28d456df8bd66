"""Queries of single operators, functions, sources and ingestion steps, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.catalog.testdata import testdata_registry
from brindle.functions import text
from brindle.operators import derive
from brindle.operators.retrieve import nearest, tiers, token_overlap
from brindle.session import read
from brindle.sources import store
from brindle.sources.normalize import edges, hierarchy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("select doc_id, cast(i as bigint) as chunk_no, md5(substring(text, 1 + 1000 * i, 1000)) as body from (select doc_id, text, unnest(range((length(text) + 999) // 1000)) as i from documents where length(text) > 0)")
def mat_chunk(spark: SparkSession, root: str) -> DataFrame:
    d = read(spark, root, "documents")
    return d.select("doc_id", F.posexplode(derive.chunks(F.col("text"))).alias("n", "c")).select("doc_id", F.col("n").cast("bigint").alias("chunk_no"), F.md5("c").alias("body"))


@query("select audio_id, cast(ord - 1 as bigint) as ord, s.speaker as speaker, s.text as text from (select audio_id, unnest(timestamp_index) as s, generate_subscripts(timestamp_index, 1) as ord from audio_asset)")
def expand_segments(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "audio_asset").select("audio_id", F.posexplode("timestamp_index").alias("ord", "s")).select("audio_id", F.col("ord").cast("bigint").alias("ord"), "s.speaker", "s.text")


@query("select r_name, count(*) as customers from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1")
def join_path_auto(spark: SparkSession, root: str) -> DataFrame:
    """Customers by region, the joins found in the registry."""
    steps = testdata_registry(spark, root).join_path("customer", "region") or []
    df = read(spark, root, "customer")
    for (_, a), (b, key) in steps:
        df = df.join(read(spark, root, b), F.col(a[0]) == F.col(key[0]))
    return df.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_small(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return read(spark, root, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select d.doc_id, coalesce(nullif(trim(d.text), ''), t.plain_text, d.title) as content from documents d left join (select document_id, min(plain_text) as plain_text from text_asset group by 1) t on t.document_id = d.doc_id")
def hydrate_left(spark: SparkSession, root: str) -> DataFrame:
    side = read(spark, root, "text_asset").groupBy("document_id").agg(F.min("plain_text").alias("plain_text"))
    d = read(spark, root, "documents")
    return d.join(side, F.col("document_id") == F.col("doc_id"), "left").select("doc_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "plain_text", "title").alias("content"))


@query("select doc_type, count(distinct court_id) as courts from documents group by 1")
def count_distinct(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").groupBy("doc_type").agg(F.count_distinct("court_id").alias("courts"))


@query("select event_id, k as key, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)")
def map_pairs(spark: SparkSession, root: str) -> DataFrame:
    e = read(spark, root, "events")
    return e.select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("p")).select("event_id", "p.key", "p.value")


_VECTOR = [((i * 7919) % 13 - 6) / 6.0 for i in range(64)]


@query(f"select vec_id, round(list_cosine_similarity(cast(embedding as double[]), {_VECTOR}::double[]), 6) as score from embeddings order by list_cosine_similarity(cast(embedding as double[]), {_VECTOR}::double[]) desc, vec_id limit 20")
def retrieve_cosine(spark: SparkSession, root: str) -> DataFrame:
    e = read(spark, root, "embeddings")
    return nearest(e, F.col("embedding"), _VECTOR, 20, [F.col("vec_id")]).select("vec_id", F.round("score", 6).alias("score"))


@query("select doc_id, cast(len(list_intersect(list_distinct([w for w in regexp_split_to_array(lower(text), '[^a-z0-9]+') if length(w) > 2]), ['arbitration', 'maritime', 'surety', 'warehouse'])) as double) as score from documents where len(list_intersect([w for w in regexp_split_to_array(lower(text), '[^a-z0-9]+') if length(w) > 2], ['arbitration', 'maritime', 'surety', 'warehouse'])) > 0 order by 2 desc, 1 limit 25")
def retrieve_overlap(spark: SparkSession, root: str) -> DataFrame:
    return token_overlap(read(spark, root, "documents"), F.col("text"), "the maritime surety of a warehouse arbitration", 25, [F.col("doc_id")]).select("doc_id", "score")


@query("select doc_id, tier from (select doc_id, case when contains(lower(text), 'express warranty') then 0 when contains(lower(text), 'express') and contains(lower(text), 'warranty') then 1 when contains(lower(text), 'express') or contains(lower(text), 'warranty') then 2 else 3 end as tier from documents) order by tier, doc_id limit 200")
def retrieve_tiered(spark: SparkSession, root: str) -> DataFrame:
    return tiers(read(spark, root, "documents"), F.col("text"), "an express warranty", 200, [F.col("doc_id")]).select("doc_id", "tier")


@query("select cluster_id, row_id from opinion_text where cluster_id is not null qualify row_number() over (partition by cluster_id order by case when opinion_type in ('010combined', '020lead') then 0 else 1 end, n_chars desc nulls last, row_id) = 1")
def lead_row(spark: SparkSession, root: str) -> DataFrame:
    """The lead opinion of each cluster by the claimed length; no window, so no task holds a cluster."""
    first = F.struct(F.when(F.col("opinion_type").isin("010combined", "020lead"), 0).otherwise(1).alias("a"), (-F.coalesce("n_chars", F.lit(-1))).alias("b"), "row_id")
    return read(spark, root, "opinion_text").where("cluster_id is not null").groupBy("cluster_id").agg(F.min(first).alias("m")).select("cluster_id", "m.row_id")


@query("select proceeding_id, status from proceeding qualify row_number() over (partition by proceeding_id order by ingested_at desc, status desc nulls last) = 1")
def upsert_last(spark: SparkSession, root: str) -> DataFrame:
    return store.last_wins(read(spark, root, "proceeding"), ["proceeding_id"], ["ingested_at", "status"]).select("proceeding_id", "status")


@query("select person_id, name_last from person qualify row_number() over (partition by person_id order by ingested_at, name_last) = 1")
def ignore_dups(spark: SparkSession, root: str) -> DataFrame:
    return store.first_wins(read(spark, root, "person"), ["person_id"], ["ingested_at", "name_last"]).select("person_id", "name_last")


@query("select proceeding_id, left(array_to_string(list_filter([case when trim(title) <> '' then 'Title: ' || trim(title) end, case when trim(status) <> '' then 'Status: ' || trim(status) end], lambda x: x is not null), chr(10) || chr(10)), 6000) as summary from proceeding")
def summary_concat(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "proceeding").select("proceeding_id", text.labelled(title=F.col("title"), status=F.col("status")).alias("summary"))


@query("select raw_id, case when regexp_full_match(left(date_filed, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(left(date_filed, 10) as date) end as filed from raw_proceeding")
def lenient_dates(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "raw_proceeding").select("raw_id", text.lenient_date(F.col("date_filed")).alias("filed"))


@query("select doc_id, coalesce(date_issued, cast(ingested_at as date)) as on_date from documents")
def doc_date_coalesce(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").select("doc_id", store.date_of(read(spark, root, "documents"), "ingested_at").alias("on_date"))


@query("select cited_opinion_id, count(*) as n from cl_citation_map where regexp_matches(cited_opinion_id, '^[0-9]+$') group by 1")
def numeric_guard(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "cl_citation_map")
    return c.where(text.numeric_id(F.col("cited_opinion_id"))).groupBy("cited_opinion_id").agg(F.count(F.lit(1)).alias("n"))


@query("select c.row_id, coalesce(m.cluster_id, 'opinion:' || c.cited_opinion_id) as cited from cl_citation_map c left join (select opinion_id, min(cluster_id) as cluster_id from cl_opinion_cluster group by 1) m on m.opinion_id = c.cited_opinion_id where c.cited_opinion_id is not null")
def citation_edges(spark: SparkSession, root: str) -> DataFrame:
    return edges(read(spark, root, "cl_citation_map"), read(spark, root, "cl_opinion_cluster")).select("row_id", "cited")


@query("select 'nation:' || n_nationkey as node, r_name || ' > ' || n_name as path from nation join region on n_regionkey = r_regionkey union all select 'region:' || r_regionkey, r_name from region")
def hierarchy_walk(spark: SparkSession, root: str) -> DataFrame:
    r = read(spark, root, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = read(spark, root, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.concat(F.lit("region:"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return hierarchy(r.unionByName(n)).select(F.col("id").alias("node"), "path")


@query("select w as word, count(*) as docs from (select distinct doc_id, unnest([x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if length(x) > 0]) as w from documents) group by 1")
def inverted_index(spark: SparkSession, root: str) -> DataFrame:
    return store.token_index(read(spark, root, "documents"), "doc_id", "text").groupBy("token").agg(F.count_distinct("owner_id").alias("docs")).withColumnRenamed("token", "word")


@query("select c_mktsegment, c_custkey, rk from (select c_mktsegment, c_custkey, cast(row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as int) as rk from customer) where rk <= 3")
def topk_per_group(spark: SparkSession, root: str) -> DataFrame:
    """Three best customers of each segment. Spark keeps k rows of a group before the shuffle."""
    rk = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return read(spark, root, "customer").withColumn("rk", rk).where("rk <= 3").select("c_mktsegment", "c_custkey", "rk")


@query("select event_type, time_bucket(interval '1 day', ts) as day, count(*) as n from events group by 1, 2")
def daily_counts(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))

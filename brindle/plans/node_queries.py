"""Queries that run plan nodes given as plans or their JSON, judges of both kinds, and whole ingestion
steps through files, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.engine import Engine, testdata_engine
from brindle.functions import ids, text
from brindle.lang.nodes import Comparison, Date, FieldRef, Fuzzy, Like, Not, Or, Query, TableRef, Unnest
from brindle.operators.judge import FunctionJudge
from brindle.plans import ir
from brindle.plans.language_queries import plain, ref, table
from brindle.session import read, shared_dir
from brindle.sources import readers, store
from brindle.sources.normalize import enriched_clusters
from brindle.streaming.ingest import stream_upsert as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def said(contents: list[str], words: str) -> list[bool | None]:
    """A judge in Python: every word of the text stands in the content."""
    return [all(w in c.lower() for w in words.lower().split()) for c in contents]


def engine(spark: SparkSession, root: str, *names: str, **judges) -> Engine:
    e = testdata_engine(spark, root, names)
    e.judges.update({"*" if k == "every" else k: j for k, j in judges.items()})
    return e


def run(e: Engine, q: Query, evidence: bool = False, **changes) -> DataFrame:
    """A query's plan, its judgements changed, run from its JSON form."""
    plan = e.plan(q).plan
    for x in list(plan.walk()):
        if changes and isinstance(x, ir.SemanticFilter):
            plan = ir.edit(plan, x.node_id, **changes)
    df = e.execute(ir.to_json(plan), evidence=evidence).frame
    return df.toDF(*map(plain, df.columns))


A, D, T = table("audio_asset", "a"), table("documents", "d"), table("text_asset", "t")
_FULL = "[s for s in timestamp_index if trim(s.text) <> '']"


@query(f"select audio_id as a_audio_id from audio_asset where len({_FULL}) > 0 and list_bool_and([contains(lower(s.text), 'the') for s in timestamp_index if trim(s.text) <> ''])")
def quant_all(spark: SparkSession, root: str) -> DataFrame:
    return run(engine(spark, root, "audio_asset"), Query((ref("a.audio_id"),), A, Fuzzy(ref("a.timestamp_index"), "the")), quantifier="ALL", text="the")


@query(f"select audio_id as a_audio_id from audio_asset where len({_FULL}) > 0 and list_bool_and([contains(lower(s.text), 'e') for s in timestamp_index if trim(s.text) <> ''])")
def quant_all_python(spark: SparkSession, root: str) -> DataFrame:
    return run(engine(spark, root, "audio_asset", every=FunctionJudge(said)), Query((ref("a.audio_id"),), A, Fuzzy(ref("a.timestamp_index"), "e")), quantifier="ALL")


@query("select audio_id as a_audio_id from audio_asset where list_bool_or([contains(lower(s.text), 'appendix') for s in timestamp_index if trim(s.text) <> ''])")
def quant_any_python(spark: SparkSession, root: str) -> DataFrame:
    return run(engine(spark, root, "audio_asset", every=FunctionJudge(said)), Query((ref("a.audio_id"),), A, Fuzzy(ref("a.timestamp_index"), "appendix")))


@query("select audio_id as a_audio_id from audio_asset where list_bool_or([not contains(lower(s.text), 'appendix') for s in timestamp_index if trim(s.text) <> ''])")
def not_unnest_python(spark: SparkSession, root: str) -> DataFrame:
    return run(engine(spark, root, "audio_asset", every=FunctionJudge(said)), Query((ref("a.audio_id"),), A, Not(Fuzzy(Unnest(ref("a.timestamp_index")), "appendix"))))


@query("select doc_id as d_doc_id from documents where coalesce(doc_type = 'bill', false) or coalesce(contains(lower(text), 'easement'), false)")
def sem_or_python(spark: SparkSession, root: str) -> DataFrame:
    where = Or((Comparison("=", ref("d.doc_type"), "bill"), Fuzzy(ref("d.text"), "easement")))
    return run(engine(spark, root, "documents", every=FunctionJudge(said)), Query((ref("d.doc_id"),), D, where))


@query("select audio_id as a_audio_id from audio_asset where duration_seconds > 3000 or list_bool_or([contains(lower(s.text), 'exhibit') for s in timestamp_index if trim(s.text) <> ''])")
def sem_or_segments(spark: SparkSession, root: str) -> DataFrame:
    where = Or((Comparison(">", ref("a.duration_seconds"), 3000), Fuzzy(Unnest(ref("a.timestamp_index")), "exhibit")))
    return run(engine(spark, root, "audio_asset"), Query((ref("a.audio_id"),), A, where))


@query("select text_id as t_text_id from text_asset where trim(plain_text) <> '' and not contains(lower(plain_text), 'court')")
def sem_empty_dropped(spark: SparkSession, root: str) -> DataFrame:
    """Blank and null texts are judged neither way."""
    return run(engine(spark, root, "text_asset"), Query((ref("t.text_id"),), T, Not(Fuzzy(ref("t.plain_text"), "court"))))


_STRIPPED = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&mdash;", "—"), ("&ndash;", "–"), ("&sect;", "§"), ("&#8212;", "—"), ("&#x2019;", "’"), ("&#167;", "§"), ("&amp;", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '{_e}', '{_c}')"


@query(f"select text_id as t_text_id from text_asset where contains(lower(trim(regexp_replace({_STRIPPED}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), ' § ')")
def mat_doc_parse(spark: SparkSession, root: str) -> DataFrame:
    """A judgement of the text that the html field is parsed into."""
    e = engine(spark, root, "text_asset", every=FunctionJudge(lambda contents, words: [" § " in c.lower() for c in contents]))
    return run(e, Query((ref("t.text_id"),), T, Fuzzy(ref("t.parsed"), "a section sign")))


@query(f"select text_id, md5(trim(regexp_replace({_STRIPPED}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as parsed from text_asset where html is not null")
def html_strip(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "text_asset").where("html is not null").select("text_id", F.md5(text.strip_html(F.col("html"))).alias("parsed"))


@query("with d as (select doc_id, text, (contains(lower(text), 'maritime')::int + contains(lower(text), 'turbine')::int) / 2.0 as c from documents where text is not null), r as (select *, percent_rank() over (order by c) as p from d) select doc_id as d_doc_id from r where trim(text) <> '' and case when p <= 0.1 then length(text) % 2 = 0 else c = 1 end")
def escalate_bottom(spark: SparkSession, root: str) -> DataFrame:
    """The least sure tenth goes to a second judge."""
    second = FunctionJudge(lambda contents, _: [len(c) % 2 == 0 for c in contents])
    return run(engine(spark, root, "documents", oracle=second), Query((ref("d.doc_id"),), D, Fuzzy(ref("d.text"), "maritime turbine")), escalation_fraction=0.1)


def _chain(*steps: Callable[[ir.Plan], ir.Plan], source: TableRef, pushed: tuple = ()) -> ir.Plan:
    at: ir.Plan = ir.Scan("scan", source, pushed)
    for step in steps:
        at = step(at)
    return at


_OVERLAP = "cast(len(list_intersect(list_distinct([w for w in regexp_split_to_array(lower(text), '[^a-z0-9]+') if length(w) > 2]), ['arbitration', 'maritime', 'surety', 'warehouse'])) as double)"


@query(f"select doc_id as d_doc_id from (select doc_id, text from documents where lang = 'en' and date_issued >= date '1990-01-01' and {_OVERLAP} > 0 order by {_OVERLAP} desc, doc_id limit 400) where contains(lower(text), 'court') and contains(lower(text), 'counsel')")
def funnel_flagship(spark: SparkSession, root: str) -> DataFrame:
    """Two exact predicates in the scan, the best 400 by shared words, then two judgements, cheapest first."""
    d = lambda f: FieldRef("d", (f,))
    plan = _chain(
        lambda p: ir.Retrieve("retrieve", d("text"), "the maritime surety of a warehouse arbitration", 400, "", "", p),
        lambda p: ir.SemanticFilter("court", "SEM", d("text"), "court of counsel", False, False, "ANY", p),
        lambda p: ir.SemanticFilter("counsel", "SEM", d("text"), "counsel", False, False, "ANY", p),
        lambda p: ir.Project("project", (d("doc_id"),), p),
        source=D,
        pushed=(Comparison("=", d("lang"), "en"), Comparison(">=", d("date_issued"), Date("1990-01-01"))),
    )
    e = engine(spark, root, "documents", every=FunctionJudge(lambda contents, words: ["court" in c.lower() if words.startswith("court") else "counsel" in c.lower() for c in contents]))
    df = e.execute(ir.to_json(plan)).frame
    return df.toDF(*map(plain, df.columns))


@query(f"select doc_id as d_doc_id from documents where {_OVERLAP} > 0 order by {_OVERLAP} desc, doc_id limit 25")
def retrieve_node(spark: SparkSession, root: str) -> DataFrame:
    d = lambda f: FieldRef("d", (f,))
    plan = _chain(lambda p: ir.Retrieve("retrieve", d("text"), "the maritime surety of a warehouse arbitration", 25, "", "", p), lambda p: ir.Project("project", (d("doc_id"),), p), source=D)
    df = engine(spark, root, "documents").execute(ir.to_json(plan)).frame
    return df.toDF(*map(plain, df.columns))


@query("select doc_id as d_doc_id from documents where doc_type = 'bill' union select doc_id from documents where court_id like 'norv%'")
def union_branches(spark: SparkSession, root: str) -> DataFrame:
    """The Union node over two branches that share a scan."""
    bill, court = Comparison("=", ref("d.doc_type"), "bill"), Like(ref("d.court_id"), "norv%")
    scan = ir.Scan("scan", D)
    plan = ir.Project("project", (ref("d.doc_id"),), ir.Union("union", Or((bill, court)), (ir.ExactFilter("one", bill, 0.1, scan), ir.ExactFilter("two", court, 0.1, scan))))
    df = engine(spark, root, "documents").execute(ir.to_json(plan)).frame
    return df.toDF(*map(plain, df.columns))


@query("select audio_id as a_audio_id, left(min_by(s.text, ord), 200) as quote from (select r, audio_id, unnest(timestamp_index) as s, generate_subscripts(timestamp_index, 1) as ord from (select row_number() over () as r, * from (select distinct audio_id, timestamp_index from audio_asset))) where contains(lower(s.text), 'statute') group by r, audio_id")
def collapse_segments(spark: SparkSession, root: str) -> DataFrame:
    """Expand, judge, collapse: each recording once, with the evidence of the first segment that met."""
    df = run(engine(spark, root, "audio_asset"), Query((ref("a.audio_id"),), A, Fuzzy(Unnest(ref("a.timestamp_index")), "statute")), evidence=True, early_exit=False)
    return df.select("a_audio_id", F.col("evidence")[0]["quote"].alias("quote"))


_TOKENS = "select distinct {id} as {short}, unnest([w for w in regexp_split_to_array(lower(text), '[^a-z0-9]+') if length(w) > 2]) as w from {table}"


@query(
    f"with l as ({_TOKENS.format(id='item_id', short='l', table='benchmark')}), r as ({_TOKENS.format(id='doc_id', short='r', table='documents')}),"
    " rare as (select w from r group by w having count(*) <= greatest(1.0, 0.1 * (select count(*) from documents))),"
    " few as (select l, r, count(*) as shared from l join rare using (w) join r using (w) group by l, r),"
    " enough as (select l from few group by l having count(*) >= 5),"
    " every as (select l, r, count(*) as shared from l join r using (w) where l not in (select l from enough) group by l, r),"
    " best as (select * from (select * from few where l in (select l from enough) union all select * from every) qualify row_number() over (partition by l order by shared desc, r) <= 5)"
    " select b.item_id as i_item_id, d.doc_id as d_doc_id from best join benchmark b on b.item_id = best.l join documents d on d.doc_id = best.r where contains(lower(b.text || chr(10) || d.text), 'motion')"
)
def semantic_join(spark: SparkSession, root: str) -> DataFrame:
    """Each benchmark item with the five documents that share most of its words, where a judge finds a motion in either."""
    plan = ir.Project("project", (ref("i.item_id"), ref("d.doc_id")), ir.SemanticJoin("join", ir.Scan("items", table("benchmark", "i")), ir.Scan("documents", D), ref("i.text"), ref("d.text"), "motion", 5))
    df = engine(spark, root, "benchmark", "documents").execute(ir.to_json(plan)).frame
    return df.toDF(*map(plain, df.columns))


_HASH = f"sha1(unhex('{ids.NAMESPACE.hex}') || encode(coalesce(source, 'unknown') || ':' || doc_id))"


@query(f"select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from (select doc_id, {_HASH} as h from documents)")
def det_id(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").select("doc_id", ids.record_id(F.coalesce("source", F.lit("unknown")), F.col("doc_id").cast("string")).alias("id"))


# ---- relations of ingestion ----------------------------------------------------------------


@query("select c.row_id, l.row_id as lead_row, l.n_chars from cl_opinion_cluster c left join (select * from opinion_text where cluster_id is not null qualify row_number() over (partition by cluster_id order by case when opinion_type in ('010combined', '020lead') then 0 else 1 end, n_chars desc nulls last, row_id) = 1) l on l.cluster_id = c.cluster_id")
def update_from_lead(spark: SparkSession, root: str) -> DataFrame:
    """Each cluster row with what its lead opinion gives it."""
    first = F.struct(F.when(F.col("opinion_type").isin("010combined", "020lead"), 0).otherwise(1).alias("a"), (-F.coalesce("n_chars", F.lit(-1))).alias("b"), F.col("row_id").alias("lead_row"))
    lead = read(spark, root, "opinion_text").where("cluster_id is not null").groupBy("cluster_id").agg(F.min_by(F.struct(F.col("row_id").alias("lead_row"), "n_chars"), first).alias("l"))
    return read(spark, root, "cl_opinion_cluster").select("row_id", "cluster_id").join(lead, "cluster_id", "left").select("row_id", "l.lead_row", "l.n_chars")


@query("select o.row_id, c.n as rows_of_cluster from opinion_text o join (select cluster_id, count(*) as n from cl_opinion_cluster group by 1) c on c.cluster_id = o.cluster_id where contains(lower(o.plain_text), 'covenant')")
def text_tier_join(spark: SparkSession, root: str) -> DataFrame:
    """Opinion texts that hold the phrase, with their clusters."""
    o = read(spark, root, "opinion_text").where(F.contains(F.lower("plain_text"), F.lit("covenant"))).select("row_id", "cluster_id")
    return o.join(read(spark, root, "cl_opinion_cluster").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("rows_of_cluster")), "cluster_id").select("row_id", "rows_of_cluster")


@query("select r.row_id, coalesce(c.cites, '') as cites from cl_opinion_cluster r left join (select citing_opinion_id, string_agg(distinct cited_opinion_id, ',' order by cited_opinion_id) as cites from cl_citation_map where citing_opinion_id is not null and cited_opinion_id is not null group by 1) c on c.citing_opinion_id = r.opinion_id")
def cluster_cites(spark: SparkSession, root: str) -> DataFrame:
    """The enriched clusters' lists of what they cite."""
    clusters = read(spark, root, "cl_opinion_cluster").select("row_id", F.col("opinion_id").alias("id"), F.lit(None).cast("string").alias("docket_id"))
    cites = read(spark, root, "cl_citation_map").select(F.col("citing_opinion_id").alias("citing_cluster_id"), F.col("cited_opinion_id").alias("cited_cluster_id"))
    none = spark.createDataFrame([], "id string, court_id string")
    return enriched_clusters(clusters, none, cites).select("row_id", F.array_join("cites", ",").alias("cites"))


@query("select r.raw_id, p.court from raw_proceeding r left join (select number, min(organization_id) as court from proceeding group by 1) p on p.number = r.number")
def docket_court(spark: SparkSession, root: str) -> DataFrame:
    """The court of a docket by its number, null where the number is no docket's."""
    courts = read(spark, root, "proceeding").groupBy("number").agg(F.min("organization_id").alias("court"))
    return read(spark, root, "raw_proceeding").select("raw_id", "number").join(courts, "number", "left").select("raw_id", "court")


@query("select opinion_id, min_by(author_str, row_id) as first_author, coalesce(string_agg(author_str, '|' order by row_id) filter (row_id <> first), '') as others from (select *, min(row_id) over (partition by opinion_id) as first from opinion_text where author_str is not null and opinion_id is not null) group by 1")
def first_and_rest(spark: SparkSession, root: str) -> DataFrame:
    """The first author given for an opinion, and the others in order."""
    o = read(spark, root, "opinion_text").where("author_str is not null and opinion_id is not null")
    every = o.groupBy("opinion_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "author_str"))).alias("a"))
    return every.select("opinion_id", F.col("a")[0]["author_str"].alias("first_author"), F.array_join(F.transform(F.slice("a", 2, 1_000_000_000), lambda x: x["author_str"]), "|").alias("others"))


@query("select doc_id, title, date_issued from documents where date_issued is not null order by date_issued, doc_id limit 50")
def ordered_head(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").where("date_issued is not null").orderBy("date_issued", "doc_id").select("doc_id", "title", "date_issued").limit(50)


# ---- scalars ------------------------------------------------------------------------------


@query("select event_id, json_extract_string(props, '$.k') as k, props::json ->> '$.none' as gap from events")
def json_path(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "events").select("event_id", text.json_at(F.col("props"), "k").alias("k"), text.json_at(F.col("props"), "none").alias("gap"))


@query("select event_id, json_extract_string(p, '$.k') as k, json_extract_string(p, '$.kind') as kind from (select event_id, json_merge_patch(props::json, json_object('kind', event_type)) as p from events)")
def json_set(spark: SparkSession, root: str) -> DataFrame:
    e = read(spark, root, "events").select("event_id", text.json_with(F.col("props"), kind=F.col("event_type")).alias("p"))
    return e.select("event_id", text.json_at(F.col("p"), "k").alias("k"), text.json_at(F.col("p"), "kind").alias("kind"))


@query("select image_id, case when trim(ocr_text) <> '' then 'ocr_text' when trim(caption) <> '' then 'caption' when trim(image_ref) <> '' then 'image_ref' end as source, md5(coalesce(nullif(trim(ocr_text), ''), nullif(trim(caption), ''), nullif(trim(image_ref), ''))) as body from image_asset")
def content_fallback(spark: SparkSession, root: str) -> DataFrame:
    c = text.content(ocr_text=F.col("ocr_text"), caption=F.col("caption"), image_ref=F.col("image_ref"))
    return read(spark, root, "image_asset").withColumn("c", c).select("image_id", F.col("c.source").alias("source"), F.md5("c.text").alias("body"))


@query("select image_id, case when page_number is null then image_ref else image_ref || '#page=' || page_number end as link from image_asset")
def page_links(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "image_asset").select("image_id", text.page_link(F.col("image_ref"), F.col("page_number")).alias("link"))


@query("select audio_id, (list_filter(timestamp_index, lambda s: contains(lower(s.text), 'statute'))[1]).start_seconds as at from audio_asset")
def audio_timestamp(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "audio_asset").select("audio_id", text.audio_start(F.col("timestamp_index"), "statute").alias("at"))


@query("select doc_id, try_strptime(nullif(regexp_extract(text, '((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})', 1), ''), '%B %d, %Y')::date as said from documents")
def title_date(spark: SparkSession, root: str) -> DataFrame:
    """The first written-out date of each text; the tables' titles hold none."""
    return read(spark, root, "documents").select("doc_id", text.date_in_title(F.col("text")).alias("said"))


@query("select person_id, w[1] as first, w[len(w)] as last from (select person_id, regexp_split_to_array(trim(regexp_replace(case when contains(n, ',') then trim(split_part(n, ',', 2)) || ' ' || trim(split_part(n, ',', 1)) else n end, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ') as w from (select person_id, name_last as n from person where name_first is null and name_last is not null)) where len(w) > 1")
def name_split(spark: SparkSession, root: str) -> DataFrame:
    """Names that stand whole in the last-name field, split."""
    p = read(spark, root, "person").where("name_first is null and name_last is not null")
    parts = text.name_parts(F.col("name_last"))
    return p.select("person_id", parts["first"].alias("first"), parts["last"].alias("last")).where("first is not null")


@query("select citing_opinion_id || ' ' || cited_opinion_id || ' ' || depth as cite, row_id from cl_citation_map where depth > 3")
def cite_strings(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "cl_citation_map").where("depth > 3").select(text.cite_string(F.col("citing_opinion_id"), F.col("cited_opinion_id"), F.col("depth")).alias("cite"), "row_id")


# ---- files --------------------------------------------------------------------------------


def _landing(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_acctbal from customer")
def read_jsonl_bad(spark: SparkSession, root: str) -> DataFrame:
    """JSON lines among blank and broken ones."""
    c, folder = read(spark, root, "customer").select("c_custkey", "c_name", "c_acctbal"), _landing(spark, "jsonl")
    good = c.select(F.to_json(F.struct("*")).alias("value"))
    bad = c.where("c_custkey % 7 = 0").select(F.explode(F.array(F.lit(" "), F.lit("{broken"), F.concat(F.lit("not json "), "c_name"))).alias("value"))
    good.unionByName(bad).write.text(folder)
    return readers.jsonl(spark, folder, c.schema)[0]


@query("select n_nationkey, n_name, n_regionkey from nation")
def read_json_wrapped(spark: SparkSession, root: str) -> DataFrame:
    """Records under a wrapping key of one document."""
    n, folder = read(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey"), _landing(spark, "json")
    rows = n.groupBy().agg(F.to_json(F.struct(F.lit(2).alias("count"), F.sort_array(F.collect_list(F.struct("*"))).alias("results"))).alias("value"))
    rows.write.text(folder)
    return readers.json_document(spark, folder).select(F.col("n_nationkey").cast(n.schema[0].dataType).alias("n_nationkey"), "n_name", F.col("n_regionkey").cast(n.schema[2].dataType).alias("n_regionkey"))


@query("select event_id, event_type, json_extract_string(props, '$.k') as k from events")
def read_csv_jsoncells(spark: SparkSession, root: str) -> DataFrame:
    """A CSV whose cells hold JSON."""
    e, folder = read(spark, root, "events").select("event_id", "event_type", "props"), _landing(spark, "csv")
    e.write.option("header", True).option("escape", '"').csv(folder)
    got = readers.csv(spark, folder, "event_id bigint, event_type string, props string", json_cells=("props",))
    return got.select("event_id", "event_type", F.expr("variant_get(props, '$.k', 'string')").alias("k"))


@query("select proceeding_id, status from proceeding qualify row_number() over (partition by proceeding_id order by ingested_at desc, status desc nulls last) = 1")
def stream_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Files that land are upserted batch by batch; a second call goes on where the first came to."""
    p, folder = read(spark, root, "proceeding").select("proceeding_id", "status", "ingested_at"), _landing(spark, "stream")
    half = p.agg(F.percentile_approx(F.unix_micros(F.col("ingested_at").cast("timestamp")), 0.5)).first()[0]
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) > (half or 0)
    into = store.Store(spark, f"{folder}/store")
    for part in (p.where(~late), p.where(late)):
        part.write.mode("append").parquet(f"{folder}/land")
        shape = lambda df: store.last_wins(df, ["proceeding_id"], ["ingested_at", "status"])
        stream(spark, f"{folder}/land", p.schema, into, "proceeding", ["proceeding_id"], f"{folder}/checkpoint", shape).awaitTermination()
    got = into.read("proceeding")
    return (p.limit(0) if got is None else got).select("proceeding_id", "status")


@query("select source, count(*) as n, count(lang) as with_lang from documents group by 1")
def normalized_sink(spark: SparkSession, root: str) -> DataFrame:
    """Entities written as JSON lines and read back."""
    folder = _landing(spark, "sink")
    readers.write_normalized({"document": read(spark, root, "documents").select("doc_id", "source", "lang")}, folder)
    back = readers.jsonl(spark, f"{folder}/document", read(spark, root, "documents").select("doc_id", "source", "lang").schema)[0]
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"))


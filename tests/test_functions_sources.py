import json
import uuid

import pytest
from pyspark.sql import functions as F

from brindle.functions import ids, text
from brindle.operators import derive
from brindle.operators.hot_join import hot_join
from brindle.operators.judge import KeywordJudge, escalate
from brindle.operators.retrieve import cosine, nearest, tiers
from brindle.operators.semjoin import blocked_join
from brindle.session import numeric_key, settle
from brindle.sources import readers
from brindle.sources.normalize import KINDS, hierarchy, normalize
from brindle.catalog.registry import FieldSpec, table_from_schema
from brindle.sources import connectors, physical
from brindle.sources.store import Store, first_wins, last_wins, pairs, unnested
from brindle.streaming.ingest import deduplicated, sessions, stream_upsert, windowed_counts


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column).collect()[0][0]


def test_uuid5_equals_pythons(spark):
    names = ["a", "Zoë", "oyez:1", "x" * 300, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(ids.uuid5(df.n)).collect()] == [str(uuid.uuid5(ids.NAMESPACE, n)) for n in names]


def test_text_functions(spark):
    assert one(spark, text.strip_html(F.col("a")), a="<p>A &amp; B</p> <b>c</b>\n") == "A & B c"
    assert one(spark, text.first_text(F.col("a"), F.col("b")), a="<p> </p>", b="<i>x</i>") == "x"
    assert one(spark, text.cite_string(F.col("a"), F.col("b"), F.col("c")), a="1", b="U.S.", c="2") == "1 U.S. 2"
    assert one(spark, text.labelled(case_name=F.col("a"), empty=F.col("b")), a="X", b=" ") == "Case name: X"
    assert str(one(spark, text.lenient_date(F.col("a")), a="2020-02-03T01:00")) == "2020-02-03" and one(spark, text.lenient_date(F.col("a")), a="soon") is None
    assert str(one(spark, text.date_in_title(F.col("a")), a="Argument - March 4, 2021 (Part 1)")) == "2021-03-04"
    assert one(spark, text.name_parts(F.col("a"))["last"], a="Doe, Jane Q.") == "Doe" and one(spark, text.name_parts(F.col("a"))["middle"], a="Doe, Jane Q.") == "Q."
    v = one(spark, text.verdict(F.col("a")), a='<think>{"match": false}</think> {"match": true, "confidence": 0.9, "rationale": "r"}')
    assert v.match and v.confidence == 0.9
    assert not one(spark, text.verdict(F.col("a")), a="no idea").match
    assert "force" in one(spark, text.excerpt(F.col("a"), ["force"], 5), a="x" * 50 + " force " + "y" * 50)


def test_numeric_key(spark):
    df = spark.createDataFrame([(x,) for x in (" 007", "cluster:7", "CLUSTER-7", "7.0", "7\t", "", None, "abc", "000")], "i string")
    assert [r[0] for r in df.select(numeric_key(df.i)).collect()] == ["7", "7", "7", "7", "7", None, None, "abc", "0"]


def test_derivations(spark):
    df = spark.createDataFrame([("x" * 2001,), ("",), (None,)], "b string")
    assert [len(r[0]) for r in df.select(derive.chunks(df.b)).collect()] == [3, 0, 0]


def test_retrieval_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id int, v array<float>")
    assert [r.id for r in nearest(df, df.v, [1.0, 0.0], 3, [df.id]).collect()] == [1, 2]
    assert df.select(cosine(df.v, [1.0, 0.0])).collect()[0][0] == pytest.approx(1.0)
    t = spark.createDataFrame([(1, "use of force"), (2, "force used: use"), (3, "force")], "id int, b string")
    assert [(r.id, r.tier) for r in tiers(t, t.b, "use of force", 10, [t.id]).collect()] == [(1, 0), (2, 1), (3, 2)]


def test_semantic_join_and_escalation(spark):
    left = spark.createDataFrame([(1, "maritime surety bond")], "l int, t string")
    right = spark.createDataFrame([(10, "the maritime bond"), (11, "a bond"), (12, "none")], "r int, u string")
    rows = blocked_join(left, right, left.t, right.u, "l", "r", 1, 0.9).collect()
    assert [tuple(r) for r in rows] == [(1, 10, 2)]
    df = spark.createDataFrame([(i, i / 10) for i in range(10)], "i int, c double")
    got = escalate(df, F.lit(False), F.lit(True), F.col("c"), 0.2).where("verdict").collect()
    assert len(got) == 2


def test_hot_join_keeps_every_row(spark, monkeypatch):
    from brindle.operators import hot_join as module

    monkeypatch.setattr(module, "HEAVY_ROWS", 5)
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.range(50).select(F.lit(99).cast("bigint").alias("k"), "id"))
    sized = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert hot_join(rows, sized, ["k"], "n").count() == 150


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (2, "d", 0)], "k int, v string, at int")
    assert {tuple(r) for r in last_wins(df, ["k"], ["at"]).select("k", "v").collect()} == {(1, "b"), (2, "d")}
    assert {tuple(r) for r in first_wins(df, ["k"], ["at"]).select("k", "v").collect()} == {(1, "a"), (2, "c")}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    s.upsert("t", spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    assert {tuple(r) for r in s.read("t").collect()} == {(1, "a"), (2, "B"), (3, "c")} and s.count("t") == 3
    assert s.get("t", k=2).first().v == "B"
    s.append("t", spark.createDataFrame([(9, "z")], "k int, v string"))
    assert s.count("t") == 4
    other = Store(spark, str(tmp_path / "other"))
    other.merge_from(s, "t", ["k"])
    assert other.count("t") == 4
    s.clear("t")
    assert s.count("t") == 0 and s.read("none") is None
    s.checkpoint("lane", "c1", 5)
    s.checkpoint("lane", "c2", 6)
    assert (s.cursor("lane"), s.records_done("lane"), s.records_done("other")) == ("c2", 11, 0)


def test_derived_tables(spark):
    df = spark.createDataFrame([(1, ["a", "b"], {"x": "y"})], "k int, arr array<string>, m map<string,string>")
    assert [tuple(r) for r in unnested(df, "k", "arr").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert [tuple(r) for r in pairs(df, "k", "m").collect()] == [(1, "x", "y")]
    assert [h.home for h in physical.plan(df, table_from_schema("t", df.columns[0], df.schema))] == ["column", "array", "map"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}], "next": None}))
    assert readers.records(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1}]))
    assert readers.records(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "d.csv").write_text('id,name,tags\n1,"a\\"b","[1,2]"\n2,,\n')
    rows = readers.copy_dump(spark, str(tmp_path / "d.csv")).collect()
    assert rows[0].name == 'a"b' and rows[1].name is None
    with pytest.raises(readers.UnknownFormat):
        readers.records(spark, "x.xml")
    assert readers.write_normalized({"t": spark.range(3)}, str(tmp_path / "out")) == {"t": 3}


def test_normalizers(spark):
    hit = spark.createDataFrame([("5", "9", "X v. Y", "2020-01-02", "ca9"), ("bad", None, None, None, None)], "id string, docket_id string, case_name string, date_filed string, court_id string")
    out = normalize("search_hit", hit)
    assert out["document"].first().envelope.id == str(uuid.uuid5(ids.NAMESPACE, "courtlistener:5")) and out["quarantine"].count() == 1
    assert out["document"].first().proceeding_id == out["proceeding"].first().envelope.id
    bill = spark.createDataFrame([("118", "HR", "1", "An act", "2023-01-09")], "congress string, type string, number string, title string, introducedDate string")
    assert normalize("bill", bill)["proceeding"].first().envelope.source_id == "118-hr-1"
    oral = spark.createDataFrame([("1", "Oral Argument - March 4, 2021", [([(0.0, 1.0, "A", [("x",), ("y",)])],)])], "id string, title string, sections array<struct<turns: array<struct<start: double, stop: double, speaker: string, text_blocks: array<struct<text: string>>>>>>")
    doc = normalize("oral_argument", oral)["document"].first()
    assert doc.segments[0].text == "x y" and str(doc.date_issued) == "2021-03-04"
    assert set(KINDS) >= {"person", "docket", "cluster", "member", "govinfo_package", "cfr_section"}
    with pytest.raises(ValueError):
        normalize("none", hit)
    tree = spark.createDataFrame([("1", None, "A"), ("2", "1", "B"), ("3", "2", "C")], "id string, parent string, name string")
    assert {r.id: r.path for r in hierarchy(tree).collect()}["3"] == "A > B > C"


def test_stream_upsert_resumes(spark, tmp_path):
    land, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(str(land / "1"))
    args = (spark, str(land / "*"), "k int, v string", store, "t", ["k"], str(tmp_path / "ck"))
    stream_upsert(*args).awaitTermination(60)
    spark.createDataFrame([(1, "A"), (2, "b")], "k int, v string").write.parquet(str(land / "2"))
    stream_upsert(*args).awaitTermination(60)
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "A"), (2, "b")}


def test_windows_on_a_stream(spark, root, tmp_path):
    events = spark.read.parquet(f"{root}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df in (("w", windowed_counts(stream, "ts", "1 day", "1 hour", "event_type")), ("d", deduplicated(stream, "ts", "1 hour", "event_id").groupBy().count()), ("s", sessions(stream, "ts", "1 hour", "1 hour", "user_id"))):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode("complete" if name == "d" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.sql("select sum(n) from out_w").first()[0] > 0


def test_settle_writes_and_reads_back(spark):
    assert settle(spark.range(5)).count() == 5


def test_excerpt_merges_windows_and_shows_several_hits(spark):
    body = "start " + "x" * 5000 + " bond one bond two " + "y" * 5000 + " bond three"
    got = one(spark, text.excerpt(F.col("a"), ["bond"], 20), a=body)
    assert got.count("bond") == 3 and got.count("\n…\n") == 1 and one(spark, text.excerpt(F.col("a"), ["bond"]), a="short") == "short"


def test_verdicts_may_nest(spark):
    got = one(spark, text.verdict(F.col("a")), a='<think>{"match": false}</think> Sure: {"match": true, "confidence": 0.7, "rationale": {"why": {"x": 1}}} end')
    assert got.match and got.confidence == 0.7
    assert one(spark, text.verdict(F.col("a")), a="none {broken").match is False and one(spark, text.verdict(F.col("a")), a=None).confidence == 0.0


def test_content_titles_links_and_json(spark):
    assert tuple(one(spark, text.content(plain_text=F.lit(" "), summary=F.col("a"), title=F.lit("t")), a=" s ")) == ("summary", "s")
    assert one(spark, text.content(plain_text=F.col("a")), a="") is None
    assert one(spark, text.display_title(F.lit("Argument"), F.col("a"), F.lit("Doe v. Roe")), a="oral_argument") == "Doe v. Roe" and one(spark, text.display_title(F.lit(" "), F.col("a"), F.lit("x")), a="bill") == "Untitled"
    assert one(spark, text.primary_url(F.lit(""), F.col("a"), F.lit("pdf")), a="page") == "page"
    assert [m.kind for m in one(spark, text.media_links(pdf=F.lit("u"), scan=F.col("a"), audio=F.lit("v")), a="u")] == ["pdf", "audio"]
    assert one(spark, text.fitted(F.col("a"), 420), a="x" * 100) == "x" * 14
    assert one(spark, text.json_at(F.col("a"), "x", "0"), a='{"x": ["q"]}') == "q"
    assert one(spark, text.json_with(F.col("a"), b=F.lit("2")), a='{"a": "1", "b": "0"}') == '{"a":"1","b":"2"}' and one(spark, text.json_with(F.col("a"), b=F.lit("2")), a=None) == '{"b":"2"}'
    assert one(spark, text.strip_html(F.col("a")), a="<p>caf&eacute; &amp; &#8217;x&#8217;</p>") == "café & ’x’"
    assert one(spark, text.media_content(F.col("a"), F.array(F.lit("i1")), F.lit("aud")), a="").ref == "i1"


def test_deep_hierarchies_and_orphans(spark):
    rows = [(str(i), None if i == 0 else str(i - 1), f"n{i}") for i in range(15)] + [("lost", "nowhere", "x"), ("c1", "c2", "a"), ("c2", "c1", "b")]
    got = {r.id: r.path for r in hierarchy(spark.createDataFrame(rows, "id string, parent string, name string"), ">").collect()}
    assert got["14"] == ">".join(f"n{i}" for i in range(15)) and len(got) == 15


def test_upsert_writes_only_its_buckets_and_old_frames_stay_good(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert("t", spark.range(500).selectExpr("id", "'a' as v"), ["id"])
    old, first = store.read("t"), store._manifest("t")
    store.upsert("t", spark.createDataFrame([(7, "b"), (999, "c")], "id bigint, v string"), ["id"])
    second = store._manifest("t")
    assert sum(first["parts"].get(b) != x for b, x in second["parts"].items()) <= 2
    assert old.where("v = 'a'").count() == 500 and store.read("t").count() == 501 and store.read("t").where("id = 7").first().v == "b"
    store.append("t", spark.createDataFrame([(7, "d")], "id bigint, v string"))
    store.upsert("t", spark.createDataFrame([(8, "e")], "id bigint, v string"), ["id"])
    assert store.read("t").count() == 501
    store.vacuum("t")
    assert store.read("t").count() == 501 and store.tables() == ["t"] and store.list("t", limit=3).count() == 3
    store.clear_all()
    assert store.read("t").count() == 0


def test_connectors_page_retry_and_go_on(spark, tmp_path):
    calls = []

    def fetch(url, params):
        calls.append(dict(params))
        if len(calls) == 1:
            return 503, None
        return 200, {"bills": [{"number": str(params["offset"] + i)} for i in range(250 if params["offset"] < 500 else 3)]}

    store, src = Store(spark, str(tmp_path / "s")), connectors.SOURCES["congress"]
    ask = connectors.patient(fetch, sleep=lambda _: None)
    assert connectors.land(spark, src, ask, str(tmp_path / "land"), store, most_pages=1) == 250
    assert connectors.land(spark, src, ask, str(tmp_path / "land"), store) == 253
    assert connectors.land(spark, src, ask, str(tmp_path / "land"), store) == 0
    assert spark.read.json(str(tmp_path / "land")).count() == 503 and [c["offset"] for c in calls] == [0, 0, 250, 500]
    report = connectors.load(spark, ["ecfr", "oyez", "none"], lambda u, p: (404, None), str(tmp_path / "l2"), store, {"ecfr": "k"})
    assert report["ecfr"].startswith("failed") and report["oyez"].startswith("skipped") and report["none"] == "unknown source"


def test_physical_layer(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], {"k": "v"}, ("q", 1), "some words here")], "id string, tags array<string>, ext map<string,string>, env struct<url: string, n: int>, body string")
    spec = table_from_schema("t", "id", df.schema, body=FieldSpec("body", "TEXT", embeddable=True))
    homes = {h.field: h for h in physical.plan(df, spec)}
    assert homes["env.n"].home == "generated" and homes["env.n"].index == "minmax" and homes["body"].index == "tokens" and homes["id"].index == "bloom"
    assert "env__url" in physical.generated(df, list(homes.values())).columns and "tags: array" in physical.describe(df, spec)
    store = Store(spark, str(tmp_path / "s"))
    store.overwrite("t", df)
    assert set(physical.apply(store, "t", spec, "id")) == {"t__tags__array", "t__ext__map", "t__body__tokens"}
    assert physical.apply(store, "t", spec, "id") == [] and len(physical.apply(store, "t", spec, "id", rebuild=True)) == 3
    assert store.read("t__body__tokens").count() == 3


def test_more_record_kinds(spark):
    from brindle.sources.normalize import citation_stubs, enriched_clusters, normalize, raw_edges

    c = normalize("court", spark.createDataFrame([("ca9", "Ninth", "F", "scotus"), (" ", "x", "F", None)], "id string, full_name string, jurisdiction string, parent_court_id string"))
    assert c["organization"].first().jurisdiction == "F" and c["organization"].first().parent_org_id and c["quarantine"].count() == 1
    d = normalize("disclosure", spark.createDataFrame([("5", "9", "2019", "x.pdf", "4")], "id string, person_id string, year string, filepath string, page_count string"))["financial_disclosure"].first()
    assert d.year == 2019 and d.page_count == 4 and d.media[0].url == "x.pdf" and d.amended is False
    assert citation_stubs(spark.createDataFrame([("1", ["5  U.S. 137", ""])], "cluster_id string, citation array<string>"))["citation"].first().cited_as == "5 U.S. 137"
    assert normalize("agency", spark.createDataFrame([("epa", "EPA")], "slug string, name string"))["organization"].first().name == "EPA"
    assert normalize("committee", spark.createDataFrame([("hsag00", "Agriculture", "House")], "systemCode string, name string, chamber string"))["organization"].first().chamber == "house"
    a = normalize("case", spark.createDataFrame([("12", "Doe v. Roe", "10-1", "Chicago", [("Ann B. Lee",)])], "ID string, name string, docket_number string, city string, advocates array<struct<name: string>>"))
    assert a["proceeding"].first().location.city == "Chicago" and a["person"].first().name_last == "Lee" and a["organization"].count() == 1
    e = enriched_clusters(spark.createDataFrame([("1", "d1"), ("2", None)], "id string, docket_id string"), spark.createDataFrame([("d1", "ca9")], "id string, court_id string"), spark.createDataFrame([("1", "7"), ("1", "3"), ("1", "7")], "citing_cluster_id string, cited_cluster_id string"))
    assert {r.id: (r.jurisdiction, r.cites) for r in e.collect()} == {"1": ("ca9", ["3", "7"]), "2": (None, [])}
    assert raw_edges(spark.createDataFrame([("1", "2", 1), ("x", "2", 1)], "citing_opinion_id string, cited_opinion_id string, depth int")).count() == 1

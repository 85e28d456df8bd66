import datetime

import pytest

from brindle.lang.nodes import Comparison, Date, FieldRef, Query, TableRef
from brindle.nl import compiler, reconcile
from brindle.operators.orphans import Reference, orphan_counts, orphan_rows


def at(text):
    return datetime.datetime.fromisoformat(text) if text else None


def refs(spark, child, parent, **options):
    c = spark.createDataFrame([(i, k, at(t), "x") for i, k, t in child], "row_id bigint, fk string, loaded_at timestamp_ntz, k string")
    p = spark.createDataFrame([(k, at(a), at(d), 1) for k, a, d in parent], "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, m int")
    return Reference("c", c, "fk", p, "id", **options)


def test_orphans_by_month_end(spark):
    child = [(1, "7", "2024-01-05"), (2, "id:7", "2024-02-05"), (3, "7", "2024-03-05"), (4, "8", "2024-01-31T23:59:59"), (5, None, "2024-01-01"), (6, " ", "2024-01-01"), (7, "9", None), (8, "7", "2023-12-31")]
    parent = [("007", "2024-01-31T23:00:00", "2024-02-15"), ("7.0", "2024-03-31", None), ("8", "2024-02-01", None)]
    got = {(r.load_month, r.row_id) for r in orphan_rows(refs(spark, child, parent)).collect()}
    # 7 is there at the end of January, deleted in February, back in March; 8 comes a month late
    assert got == {("2024-02", 2), ("2024-01", 4), ("2023-12", 8)}
    counts = {r.load_month: (r.ref_rows, r.orphan_rows, r.orphan_keys) for r in orphan_counts(refs(spark, child, parent)).collect()}
    assert counts["2024-01"] == (2, 1, 1) and counts["2024-03"] == (1, 0, 0)


def test_deletion_exactly_at_month_end_is_too_late(spark):
    child = [(1, "1", "2024-01-05"), (2, "2", "2024-01-05")]
    parent = [("1", "2024-01-01", "2024-02-01T00:00:00"), ("2", "2024-01-01", "2024-01-31T23:59:59")]
    assert [r.row_id for r in orphan_rows(refs(spark, child, parent)).collect()] == [2]


def test_empty_tables_and_repeats(spark):
    assert orphan_rows(refs(spark, [], [("1", "2024-01-01", None)])).count() == 0
    assert orphan_rows(refs(spark, [(1, "1", "2024-01-05"), (2, "1", "2024-01-06")], [])).count() == 2


@pytest.mark.parametrize(
    ("question", "want"),
    [("cases since 2015", [">= 2015-01-01"]), ("after 2015", ["> 2015-12-31"]), ("until 2015", ["<= 2015-12-31"]), ("before 2015", ["< 2015-01-01"]), ("in 2015", ["between"]), ("between 2010 and 2012", ["between"]), ("none", [])],
)
def test_date_phrases(question, want):
    found = reconcile.date_conditions(question, FieldRef("d", ("issued",)))
    assert [f"{c.op} {c.field2.value}" if isinstance(c, Comparison) else "between" for c in found] == want


def test_reading_questions():
    assert reconcile.circuit("the Ninth Circuit held") == "ca9" and reconcile.circuit("2nd Circuit") == "ca2" and reconcile.circuit("D.C. Circuit") == "cadc" and reconcile.circuit("court") is None
    assert reconcile.cannot_express("the newest cases") == ["newest"]
    assert reconcile.extract_json('<think>{"a": 1}</think>```json\n{"b": {"c": 2}}\n``` tail') == {"b": {"c": 2}}
    assert compiler.route("tell me a joke") == "reject" and compiler.route("What is standing?") == "answer" and compiler.route("Find cases on standing") == "compile"


def test_compile_loop_repairs_and_caches():
    from tests.test_engine import registry

    replies = iter(["no json", '{"select": [{"source": "d", "path": "nope"}], "source": {"name": "doc", "alias": "d"}}', '{"select": [{"source": "d", "path": "id"}], "source": {"name": "doc", "alias": "d"}}'])
    c = compiler.Compiler(registry(), lambda messages, temperature: next(replies), date_fields={"doc": FieldRef("doc", ("issued",))})
    done = c.compile("documents since 2020")
    assert done.ok and done.attempts == 3
    assert done.query == Query((FieldRef("d", ("id",)),), TableRef("doc", "d"), Comparison(">=", FieldRef("d", ("issued",)), Date("2020-01-01")))
    assert c.compile("Documents  since 2020").cached


def test_entry_points(spark, root):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["d_doc_id"]


def test_language_queries_match_duckdb(spark, root):
    import duckdb

    from brindle.plans import language_queries, orphan_queries

    con = duckdb.connect()
    for name in ("nation", "region", "customer", "orders", "documents", "audio_asset", "person", "cl_citation_map", "cl_opinion_cluster", "opinion_text"):
        con.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    for part, names in ((language_queries, ("join_2hop_filter", "sem_or_exact", "not_unnest_exists", "group_by_unnest")), (orphan_queries, ("p4_found", "p4_counts"))):
        for name in names:
            df = part.QUERIES[name](spark, root)
            cur = con.execute(part.SQL[name])
            cols = [d[0] for d in cur.description]
            want = sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
            assert sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want, name


def test_aliases_courts_and_topics_are_reconciled():
    from brindle.lang.nodes import And, Comparison, FieldRef, Fuzzy, Like, Query, TableRef
    from brindle.nl import compiler, reconcile

    d = lambda f, a="d": FieldRef(a, (f,))
    q = Query((FieldRef("documents", ("doc_id",)),), TableRef("documents", "d"), Comparison("=", FieldRef("x", ("lang",)), "en"))
    fixed = reconcile.on_aliases(q, {"documents": {"doc_id", "lang"}})
    assert fixed == Query((d("doc_id"),), TableRef("documents", "d"), Comparison("=", d("lang"), "en"))
    assert reconcile.court_condition("opinions of the Ninth Circuit", d("court_id")) == [Comparison("=", d("court_id"), "ca9")]
    assert reconcile.court_condition("Supreme Court opinions on bonds", d("court_id")) == [Comparison("=", d("court_id"), "scotus")]
    assert reconcile.court_condition("Cases later reversed by the Supreme Court", d("court_id")) == [] and reconcile.reviewed("cases the Supreme Court reversed")
    assert reconcile.topics('opinions about excessive force since 2015, with "qualified immunity"') == ["qualified immunity", "excessive force"]
    bare = Query((d("doc_id"),), TableRef("documents", "d"))
    judged = reconcile.with_topics("opinions about excessive force since 2015", bare, d("text"))
    assert judged.where == Fuzzy(d("text"), "excessive force") and reconcile.coverage_errors("opinions about excessive force", judged) == []
    other = Query((d("doc_id"),), TableRef("documents", "d"), And((Fuzzy(d("text"), "maritime liens"), Like(d("title"), "%force%"))))
    assert [e["code"] for e in reconcile.coverage_errors("opinions about patents", other)] == ["missing_topic", "invented_topic"]
    long = [{"role": "system", "content": "s" * 100}, *({"role": r, "content": "x" * 500} for r in ("user", "assistant") * 4), {"role": "user", "content": "now"}, {"role": "assistant", "content": "y"}]
    kept = compiler.fit(long, 500)
    assert kept[0] == long[0] and kept[-2:] == long[-2:] and len(kept) < len(long)


def test_routes_by_rule():
    from brindle.nl.compiler import route

    assert route("find opinions about bonds") == "compile" and route("opinions since 2015") == "compile" and route("What is stare decisis doctrine?") == "answer"
    assert route("What does qualified immunity law protect?") == "answer" and route("how do I bake bread") == "reject" and route("hi") == "reject"

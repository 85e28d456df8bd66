"""One query for each construct of the language over the project's tables, with its SQL.

Each goes through the whole engine: checks, planner, compiler.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.engine import testdata_engine
from brindle.lang.nodes import Aggregator, And, Between, Comparison, Date, FieldRef, Fuzzy, InList, Join, Like, Not, Or, Query, TableRef, Unnest, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ref(dotted: str) -> FieldRef:
    source, *path = dotted.split(".")
    return FieldRef(source, tuple(path))


def table(name: str, alias: str | None = None) -> TableRef:
    return TableRef(name, alias or name)


def joined(first: TableRef, *steps: tuple[TableRef, str, str]):
    at = first
    for t, a, b in steps:
        at = Join(Comparison("=", ref(a), ref(b)), at, t)
    return at


def plain(label: str) -> str:
    """A printed expression as a column name without punctuation."""
    return re.sub(r"\W+", "_", label).strip("_")


def add(name: str, sql: str, select: list, source, where=None, group_by: list | None = None, limit: int | None = None) -> None:
    fields = tuple(ref(s) if isinstance(s, str) else s for s in select)
    used = tuple(dict.fromkeys(t.name for t in tables(source)))
    query = Query(fields, source, where, tuple(ref(g) if isinstance(g, str) else g for g in group_by or ()), limit)

    def run(spark: SparkSession, root: str) -> DataFrame:
        df = testdata_engine(spark, root, used).query(query)
        return df.toDF(*map(plain, df.columns))

    QUERIES[name], SQL[name] = run, re.sub(r'as "([^"]+)"', lambda m: f'as "{plain(m[1])}"', sql)


L, O = table("lineitem", "l"), table("orders", "o")  # noqa: E741
cmp = lambda op, a, b: Comparison(op, ref(a), ref(b[1:]) if isinstance(b, str) and b.startswith("@") else b)

add("scan_project", 'select l_orderkey as "l.l_orderkey", l_quantity as "l.l_quantity" from lineitem', ["l.l_orderkey", "l.l_quantity"], L)
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    add(f"cmp_{_name}", f'select l_orderkey as "l.l_orderkey", l_linenumber as "l.l_linenumber" from lineitem where l_quantity {_op} 24', ["l.l_orderkey", "l.l_linenumber"], L, cmp(_op, "l.l_quantity", 24))
add("cmp_affinity_text", 'select p_partkey as "p.p_partkey" from part where p_size = 12', ["p.p_partkey"], table("part", "p"), cmp("=", "p.p_size", "12"))
add("cmp_date_iso_text", """select o_orderkey as "o.o_orderkey" from orders where o_orderdate >= timestamp '1997-06-01'""", ["o.o_orderkey"], O, cmp(">=", "o.o_orderdate", "1997-06-01"))
add("field_field_cmp", 'select l_orderkey as "l.l_orderkey", l_linenumber as "l.l_linenumber" from lineitem where l_discount > l_tax', ["l.l_orderkey", "l.l_linenumber"], L, cmp(">", "l.l_discount", "@l.l_tax"))
add("in_list", """select o_orderkey as "o.o_orderkey" from orders where o_orderpriority in ('1-URGENT', '2-HIGH')""", ["o.o_orderkey"], O, InList(ref("o.o_orderpriority"), ("1-URGENT", "2-HIGH")))
add("between_num", 'select p_partkey as "p.p_partkey" from part where p_size between 10 and 20', ["p.p_partkey"], table("part", "p"), Between(ref("p.p_size"), 10, 20))
add("between_date", """select o_orderkey as "o.o_orderkey" from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1996-12-31'""", ["o.o_orderkey"], O, Between(ref("o.o_orderdate"), Date("1996-01-01"), Date("1996-12-31")))
add("like_infix", """select doc_id as "d.doc_id" from documents where title ilike '%trust%'""", ["d.doc_id"], table("documents", "d"), Like(ref("d.title"), "%trust%"))
add("like_prefix", """select c_custkey as "c.c_custkey" from customer where c_mktsegment ilike 'build%'""", ["c.c_custkey"], table("customer", "c"), Like(ref("c.c_mktsegment"), "build%"))
add("and_or_not", """select o_orderkey as "o.o_orderkey" from orders where (o_totalprice > 200000 or o_orderstatus = 'F') and not (o_orderpriority = '1-URGENT' or o_orderkey < 100)""", ["o.o_orderkey"], O, And((Or((cmp(">", "o.o_totalprice", 200000), cmp("=", "o.o_orderstatus", "F"))), Not(Or((cmp("=", "o.o_orderpriority", "1-URGENT"), cmp("<", "o.o_orderkey", 100)))))))

_c, _n, _r = table("customer", "c"), table("nation", "n"), table("region", "r")
add("join_1hop", 'select o_orderkey as "o.o_orderkey", c_name as "c.c_name" from orders join customer on o_custkey = c_custkey', ["o.o_orderkey", "c.c_name"], joined(O, (_c, "o.o_custkey", "c.c_custkey")))
add("join_2hop_filter", """select o_orderkey as "o.o_orderkey", n_name as "n.n_name" from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where c_acctbal > 5000 and o_totalprice < 100000""", ["o.o_orderkey", "n.n_name"], joined(O, (_c, "o.o_custkey", "c.c_custkey"), (_n, "c.c_nationkey", "n.n_nationkey")), And((cmp(">", "c.c_acctbal", 5000), cmp("<", "o.o_totalprice", 100000))))
add(
    "join_5hop", 'select r_name as "r.r_name", sum(l_quantity) as "sum(l.l_quantity)", count(*) as "count(*)" from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1',
    ["r.r_name", Aggregator("sum", ref("l.l_quantity")), Aggregator("count")], joined(L, (O, "l.l_orderkey", "o.o_orderkey"), (_c, "o.o_custkey", "c.c_custkey"), (_n, "c.c_nationkey", "n.n_nationkey"), (_r, "n.n_regionkey", "r.r_regionkey")), group_by=["r.r_name"],
)
add("self_join_edge", 'select a.n_name as "a.n_name", b.n_name as "b.n_name" from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey', ["a.n_name", "b.n_name"], joined(table("nation", "a"), (table("nation", "b"), "a.n_regionkey", "b.n_regionkey")), cmp("<", "a.n_nationkey", "@b.n_nationkey"))

_g = ["o.o_orderpriority"]
add("agg_count_star", 'select o_orderpriority as "o.o_orderpriority", count(*) as "count(*)" from orders group by 1', [*_g, Aggregator("count")], O, group_by=_g)
add("agg_count", 'select lang as "d.lang", count(text) as "count(d.text)" from documents group by 1', ["d.lang", Aggregator("count", ref("d.text"))], table("documents", "d"), group_by=["d.lang"])
add("agg_sum", 'select o_orderpriority as "o.o_orderpriority", cast(sum(o_custkey) as bigint) as "sum(o.o_custkey)" from orders group by 1', [*_g, Aggregator("sum", ref("o.o_custkey"))], O, group_by=_g)
add("agg_avg_min_max", 'select l_returnflag as "l.l_returnflag", avg(l_linenumber) as "avg(l.l_linenumber)", min(l_quantity) as "min(l.l_quantity)", max(l_shipdate) as "max(l.l_shipdate)" from lineitem group by 1', ["l.l_returnflag", Aggregator("avg", ref("l.l_linenumber")), Aggregator("min", ref("l.l_quantity")), Aggregator("max", ref("l.l_shipdate"))], L, group_by=["l.l_returnflag"])
add("agg_global", 'select count(*) as "count(*)", min(o_totalprice) as "min(o.o_totalprice)" from orders', [Aggregator("count"), Aggregator("min", ref("o.o_totalprice"))], O)
add("distinct_keys", 'select distinct l_returnflag as "l.l_returnflag", l_linestatus as "l.l_linestatus" from lineitem', ["l.l_returnflag", "l.l_linestatus"], L, group_by=["l.l_returnflag", "l.l_linestatus"])
add("limit_all", 'select r_name as "r.r_name" from region limit 100', ["r.r_name"], _r, limit=100)

_d = table("documents", "d")
add("sem_text", """select doc_id as "d.doc_id" from documents where contains(lower(text), 'arbitration')""", ["d.doc_id"], _d, Fuzzy(ref("d.text"), "arbitration"))
add("sem_funnel", """select doc_id as "d.doc_id" from documents where lang = 'en' and date_issued >= date '2010-01-01' and contains(lower(text), 'maritime') and contains(lower(text), 'turbine')""", ["d.doc_id"], _d, And((Fuzzy(ref("d.text"), "maritime turbine"), cmp("=", "d.lang", "en"), cmp(">=", "d.date_issued", Date("2010-01-01")))))
add("sem_negated", """select doc_id as "d.doc_id" from documents where trim(text) <> '' and not contains(lower(text), 'arbitration')""", ["d.doc_id"], _d, Not(Fuzzy(ref("d.text"), "arbitration")))
add("sem_or_exact", """select doc_id as "d.doc_id" from documents where coalesce(doc_type = 'bill', false) or coalesce(contains(lower(text), 'easement'), false)""", ["d.doc_id"], _d, Or((cmp("=", "d.doc_type", "bill"), Fuzzy(ref("d.text"), "easement"))))
_a = table("audio_asset", "a")
_seg = "from audio_asset a, (select unnest(timestamp_index) as s)"
add("quant_any_segments", "select audio_id as \"a.audio_id\" from audio_asset where list_bool_or([contains(lower(s.text), 'appendix') for s in timestamp_index if trim(s.text) <> ''])", ["a.audio_id"], _a, Fuzzy(ref("a.timestamp_index"), "appendix"))
add("not_any_segment", "select audio_id as \"a.audio_id\" from audio_asset where len([1 for s in timestamp_index if trim(s.text) <> '']) > 0 and not list_bool_or([contains(lower(s.text), 'appendix') for s in timestamp_index if trim(s.text) <> ''])", ["a.audio_id"], _a, Not(Fuzzy(ref("a.timestamp_index"), "appendix")))
add("unnest_exists", "select audio_id as \"a.audio_id\" from audio_asset where list_bool_or([contains(lower(s.text), 'appendix') for s in timestamp_index if trim(s.text) <> ''])", ["a.audio_id"], _a, Fuzzy(Unnest(ref("a.timestamp_index")), "appendix"))
add("not_unnest_exists", "select audio_id as \"a.audio_id\" from audio_asset where list_bool_or([not contains(lower(s.text), 'appendix') for s in timestamp_index if trim(s.text) <> ''])", ["a.audio_id"], _a, Not(Fuzzy(Unnest(ref("a.timestamp_index")), "appendix")))
add("unnest_observed", "select audio_id as \"a.audio_id\", s.text as \"unnest(a.timestamp_index).text\" from (select audio_id, unnest(timestamp_index) as s from audio_asset) where contains(lower(s.text), 'appendix')", ["a.audio_id", Unnest(ref("a.timestamp_index"), ("text",))], _a, Fuzzy(Unnest(ref("a.timestamp_index")), "appendix"))
_p = table("person", "p")
add("set_member", "select person_id as \"p.person_id\", source_system as \"p.source_system\" from person where list_contains(role_types, 'judge')", ["p.person_id", "p.source_system"], _p, cmp("=", "p.role_types", "judge"))
add("set_not_member", "select person_id as \"p.person_id\" from person where not list_contains(role_types, 'judge')", ["p.person_id"], _p, cmp("!=", "p.role_types", "judge"))
add("set_overlap", "select person_id as \"p.person_id\" from person where list_has_any(role_types, ['party', 'official'])", ["p.person_id"], _p, InList(ref("p.role_types"), ("party", "official")))
add("set_like", "select person_id as \"p.person_id\" from person where list_bool_or([r ilike 'leg%' for r in role_types])", ["p.person_id"], _p, Like(ref("p.role_types"), "leg%"))
add("unnest_select", 'select person_id as "p.person_id", unnest(role_types) as "unnest(p.role_types)" from person', ["p.person_id", Unnest(ref("p.role_types"))], _p)
add("group_by_unnest", 'select r as "unnest(p.role_types)", count(*) as "count(*)" from (select unnest(role_types) as r from person) group by 1', [Unnest(ref("p.role_types")), Aggregator("count")], _p, group_by=[Unnest(ref("p.role_types"))])
add("mat_chunk_any", "select doc_id as \"d.doc_id\" from documents where list_bool_or([contains(lower(substring(text, 1 + 1000 * i, 1000)), 'tenancy') for i in range((length(text) + 999) // 1000) if trim(substring(text, 1 + 1000 * i, 1000)) <> ''])", ["d.doc_id"], _d, Fuzzy(ref("d.chunks"), "tenancy"))
add("mat_transcript", "select audio_id as \"a.audio_id\" from audio_asset where contains(lower(array_to_string([s.text for s in timestamp_index], ' ')), 'warehouse')", ["a.audio_id"], _a, Fuzzy(ref("a.spoken"), "warehouse"))
_t = table("text_asset", "t")
add("join_documents_assets", """select text_id as "t.text_id", d.doc_type as "d.doc_type" from text_asset t join documents d on t.document_id = d.doc_id where d.lang = 'en'""", ["t.text_id", "d.doc_type"], joined(_t, (_d, "t.document_id", "d.doc_id")), cmp("=", "d.lang", "en"))

import datetime

import pytest

from brindle.catalog.registry import FieldSpec, Registry, RegistryError, TableSpec
from brindle.engine import Engine, QueryRejected
from brindle.lang import checks, wire
from brindle.lang.nodes import Aggregator, And, Between, Comparison, Date, FieldRef, Fuzzy, InList, Join, Like, Not, Or, Query, TableRef, Unnest
from brindle.operators.judge import FunctionJudge, KeywordJudge, keywords, needed, phrase
from brindle.plans import cost, ir, planner

SEGMENTS = (("start_seconds", "offset"), ("text", "text"))


def registry() -> Registry:
    s = FieldSpec
    doc = {("id",): s("id"), ("title",): s("title", "TEXT"), ("kind",): s("kind"), ("issued",): s("issued", "DATE"), ("tags",): s("tags", unit="item", fanout=2), ("body",): s("body", "TEXT", embeddable=True), ("chunks",): s("chunks", "TEXT_CHUNKED", "chunk", 4, derivation="CHUNK", source_field="body"), ("talk",): s("talk", "AUDIO", "segment", 3, parts=SEGMENTS), ("alltalk",): s("alltalk", "AUDIO", "segment", 3, quantifier="ALL", parts=SEGMENTS), ("org",): s("org")}
    org = {("id",): s("id"), ("name",): s("name", "TEXT")}
    return Registry("toy", [TableSpec("doc", ("id",), doc), TableSpec("org", ("id",), org), TableSpec("far", ("id",), {("id",): s("id")})], [(("doc", ("org",)), ("org", ("id",)))])


@pytest.fixture(scope="module")
def engine(spark):
    seg = lambda *t: [{"start_seconds": float(i), "text": x} for i, x in enumerate(t)]
    rows = [
        ("old", "Old 2019", "opinion", datetime.date(2019, 6, 1), ["a", "b"], "the harbor pilot slept", seg("good day", "harbor"), seg("harbor one", "harbor two"), "o1"),
        ("new", "New 2021", "opinion", datetime.date(2021, 3, 4), ["b"], "no pilot at the harbor", seg("nothing"), seg("harbor", "none"), "o1"),
        ("edge", "Edge", "bill", datetime.date(2020, 1, 1), [], "", [], [], "o2"),
        ("blank", None, None, None, None, None, None, None, None),
    ]
    schema = "id string, title string, kind string, issued date, tags array<string>, body string, talk array<struct<start_seconds: double, text: string>>, alltalk array<struct<start_seconds: double, text: string>>, org string"
    return Engine(registry(), {"doc": spark.createDataFrame(rows, schema), "org": spark.createDataFrame([("o1", "Court"), ("o2", None)], "id string, name string"), "far": spark.createDataFrame([("x",)], "id string")})


D = lambda *p: FieldRef("d", p)


def ids(engine, where) -> set:
    return {r[0] for r in engine.query(Query((D("id"),), TableRef("doc", "d"), where)).collect()}


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (Comparison(">=", D("issued"), Date("2020-01-01")), {"edge", "new"}),
        (Comparison(">=", D("issued"), "2020-01-01"), {"edge", "new"}),
        (Between(D("issued"), Date("2020-01-01"), Date("2020-12-31")), {"edge"}),
        (Like(D("title"), "%2021%"), {"new"}),
        (InList(D("kind"), ("opinion",)), {"old", "new"}),
        (Comparison("=", D("tags"), "b"), {"old", "new"}),
        (Comparison("!=", D("tags"), "a"), {"new", "edge"}),
        (InList(D("tags"), ("a", "z")), {"old"}),
        (Not(Comparison("=", D("kind"), "bill")), {"old", "new"}),
        (Fuzzy(D("body"), "pilot"), {"old", "new"}),
        (Not(Fuzzy(D("body"), "slept")), {"new"}),
        (Fuzzy(D("talk"), "harbor"), {"old"}),
        (Not(Fuzzy(D("talk"), "harbor")), {"new"}),
        (Not(Fuzzy(Unnest(D("talk")), "harbor")), {"old", "new"}),
        (Fuzzy(D("alltalk"), "harbor"), {"old"}),
        (Fuzzy(D("chunks"), "slept"), {"old"}),
        (Or((Comparison("=", D("kind"), "bill"), Fuzzy(D("body"), "slept"))), {"old", "edge"}),
        (And((Fuzzy(D("body"), "pilot"), Comparison("=", D("id"), "new"))), {"new"}),
    ],
)
def test_predicates(engine, where, want):
    assert ids(engine, where) == want


def test_join_group_and_limit(engine):
    source = Join(Comparison("=", D("org"), FieldRef("o", ("id",))), TableRef("doc", "d"), TableRef("org", "o"))
    rows = engine.query(Query((FieldRef("o", ("name",)), Aggregator("count")), source, None, (FieldRef("o", ("name",)),))).collect()
    assert {(r[0], r[1]) for r in rows} == {("Court", 2), (None, 1)}
    assert engine.query(Query((D("id"),), TableRef("doc", "d"), None, (), 2)).count() == 2
    assert engine.query(Query((Aggregator("count"),), TableRef("doc", "d"), Comparison("=", D("id"), "none"))).collect()[0][0] == 0


def test_elements_observed_and_evidence(engine):
    q = Query((D("id"), Unnest(D("talk"), ("text",))), TableRef("doc", "d"), Fuzzy(Unnest(D("talk")), "harbor"))
    assert [tuple(r) for r in engine.query(q).collect()] == [("old", "harbor")]
    got = engine.run(Query((D("id"),), TableRef("doc", "d"), Fuzzy(D("body"), "slept")), evidence=True, observe=True)
    row = got.frame.collect()[0]
    assert row.evidence[0].confidence == 1.0 and row.evidence[0].label == "d.body"
    assert [s["rows_out"] for s in got.funnel()][-1] == 1


def test_function_judge_sees_each_content_once_and_only_what_is_needed(engine, spark):
    judge = FunctionJudge(lambda contents, text: [text in c for c in contents])
    own = Engine(engine.registry, engine.tables, {"*": judge})
    own.estimator = cost.Estimator()
    assert ids(own, And((Fuzzy(D("body"), "pilot"), Fuzzy(D("body"), "slept")))) == {"old"}


def test_exact_filters_reach_the_scan_below_judgements(engine):
    q = Query((D("id"),), TableRef("doc", "d"), And((Fuzzy(D("body"), "pilot"), Comparison("=", D("kind"), "opinion"))))
    planned = engine.plan(q)
    scan = ir.pipeline(planned.plan)[0]
    assert [str(c) for c in scan.pushed] == ['d.kind = "opinion"'] and not planned.blocked and not planned.warnings


def test_plan_json_and_edits(engine):
    q = Query((D("id"),), TableRef("doc", "d"), And((Fuzzy(Unnest(D("talk")), "harbor"), Or((Comparison("=", D("kind"), "bill"), Fuzzy(D("body"), "x"))))), (), 3)
    plan = engine.plan(q).plan
    assert ir.from_json(ir.to_json(plan)) == plan
    assert engine.execute(ir.to_json(plan)).frame.count() == 0
    assert "Expand(d.talk)" in ir.render(plan)
    sem = next(x for x in plan.walk() if isinstance(x, ir.SemanticFilter))
    assert sem.early_exit and not any(isinstance(x, ir.Limit) for x in ir.drop(plan, next(x.node_id for x in plan.walk() if isinstance(x, ir.Limit))).walk())
    broken = ir.edit(plan, sem.node_id, bound_model="none", selectivity=2.0)
    assert {d["code"] for d in planner.defects(broken, engine.estimator)} >= {"unknown_model", "selectivity_range"}


def test_blocks_run_by_cost_over_one_minus_selectivity(engine):
    q = Query((D("id"),), TableRef("doc", "d"), And((Fuzzy(Unnest(D("talk")), "harbor"), Fuzzy(D("body"), "pilot"))))
    plan = engine.plan(q).plan
    order = [x.field.path[0] for x in ir.pipeline(plan) if isinstance(x, ir.SemanticFilter)]
    assert order == ["body", "talk"]
    ratios = [r for _, r in planner.explain_order(plan, engine.estimator)]
    assert ratios == sorted(ratios)


def test_cost_formulas():
    est = cost.Estimator(cost.Stats(rows={"doc": 1000}))
    assert est.early_calls(10, 0.5) == pytest.approx((1 - 0.5**10) / 0.5)
    scan = ir.Scan("s", TableRef("doc", "d"), (), 0.1)
    sem = ir.SemanticFilter("f", "SEM", D("body"), "x", False, False, "ANY", scan, "text-local", "", 0.2)
    stages = est.funnel(ir.Limit("l", 5, True, sem))
    assert [s.rows_out for s in stages] == [100, 20, 5] and stages[1].model_calls == 100
    assert stages[1].seconds == pytest.approx(100 / 5.8)


@pytest.mark.parametrize(
    ("query", "code"),
    [
        (Query((D("id"),), TableRef("nope", "d")), "unknown_table"),
        (Query((D("id"),), Join(Comparison("=", D("org"), FieldRef("d", ("id",))), TableRef("doc", "d"), TableRef("org", "d"))), "duplicate_alias"),
        (Query((FieldRef("x", ("id",)),), TableRef("doc", "d")), "table_not_in_scope"),
        (Query((D("titel"),), TableRef("doc", "d")), "unknown_field"),
        (Query((D("id"),), TableRef("doc", "d"), Comparison("=", D("id"), "d.title")), "field_as_string"),
        (Query((Unnest(D("id")),), TableRef("doc", "d")), "unnest_scalar"),
        (Query((Aggregator("sum", Aggregator("count")),), TableRef("doc", "d")), "nested_aggregate"),
        (Query((D("id"), Aggregator("count")), TableRef("doc", "d")), "ungrouped_select"),
        (Query((D("id"),), TableRef("doc", "d"), None, (1,)), "bad_group_by"),
        (Query((D("id"),), Join(Comparison("<", D("org"), FieldRef("o", ("id",))), TableRef("doc", "d"), TableRef("org", "o"))), "bad_join_op"),
        (Query((D("id"),), Join(Comparison("=", D("org"), D("id")), TableRef("doc", "d"), TableRef("org", "o"))), "bad_join_scope"),
        (Query((D("id"),), Join(Comparison("=", D("id"), FieldRef("o", ("id",))), TableRef("doc", "d"), TableRef("org", "o"))), "unknown_join_edge"),
        (Query((D("id"),), Join(Like(D("id"), "x"), TableRef("doc", "d"), TableRef("org", "o"))), "bad_join"),
        (Query((D("id"),), TableRef("doc", "d"), Fuzzy(D("kind"), "x")), "fuzzy_on_scalar"),
        (Query((D("id"),), TableRef("doc", "d"), Fuzzy("body", "x")), "bad_fuzzy_field"),
        (Query((D("id"),), TableRef("doc", "d"), Comparison("=", Aggregator("count"), 1)), "bad_comparison_expression"),
        (Query((D("id"),), TableRef("doc", "d"), Comparison("=", D("talk"), "x")), "exact_on_modal_field"),
        (Query((D("id"),), TableRef("doc", "d"), Comparison("=", D("issued"), "soon")), "bad_date_literal"),
        (Query((D("id"),), TableRef("doc", "d"), Comparison("=", D("kind"), Date("2020-01-01"))), "date_on_non_date_field"),
    ],
)
def test_checks(engine, query, code):
    assert code in {e["code"] for e in checks.validate(query, engine.registry)}
    with pytest.raises(QueryRejected):
        engine.plan(query)


def test_registry(engine):
    reg = engine.registry
    assert Registry.from_dict(reg.to_dict()).to_dict() == reg.to_dict()
    assert reg.join_path("org", "doc") == [(("org", ("id",)), ("doc", ("org",)))] and reg.join_path("doc", "far") is None
    assert "did you mean 'title'" in reg.suggest("titel", ["title", "body"]) and "body: TEXT" in reg.prompt()
    with pytest.raises(RegistryError):
        Registry("bad", [TableSpec("t", ("id",), {("id",): FieldSpec("id", "BLOB")})])


def test_check_reports_wire_errors_first(engine):
    assert engine.check({"kind": "Query"})[0]["code"] == "missing_key"
    assert engine.check(wire.encode(Query((D("id"),), TableRef("doc", "d")))) == []


def test_keywords_and_phrase():
    assert keywords("Did the officer in Reno use excessive force?") == ["Reno", "excessive", "officer", "force", "use"]
    assert needed("Did the officer in Reno use force?") == ["Reno"]
    assert phrase("the use of force by a") == "use of force"


def test_keyword_judge_is_null_on_blank(spark):
    df = spark.createDataFrame([("",), (None,), ("a bond",)], "t string")
    assert [r[0] for r in df.select(KeywordJudge().column(df.t, "bond")).collect()] == [None, None, True]


def python_engine(engine) -> Engine:
    judge = FunctionJudge(lambda contents, text: [all(w in c.lower() for w in text.split()) for c in contents], lambda contents, text: [0.1 if "pilot" in c else 0.9 for c in contents])
    return Engine(engine.registry, engine.tables, {"*": judge})


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (Fuzzy(D("talk"), "harbor"), {"old"}),
        (Not(Fuzzy(D("talk"), "harbor")), {"new"}),
        (Fuzzy(Unnest(D("talk")), "harbor"), {"old"}),
        (Not(Fuzzy(Unnest(D("talk")), "harbor")), {"old", "new"}),
        (Fuzzy(D("alltalk"), "harbor"), {"old"}),
        (Fuzzy(D("chunks"), "slept"), {"old"}),
        (Or((Comparison("=", D("kind"), "bill"), Fuzzy(D("body"), "slept"))), {"old", "edge"}),
        (Or((Comparison("=", D("kind"), "bill"), Fuzzy(D("alltalk"), "harbor"))), {"old", "edge"}),
        (Or((Fuzzy(D("body"), "slept"), Not(Fuzzy(Unnest(D("talk")), "harbor")))), {"old", "new"}),
    ],
)
def test_python_judges_decide_like_the_native_one(engine, where, want):
    assert ids(python_engine(engine), where) == want == ids(engine, where)


def test_an_or_uses_the_judge_its_branch_is_bound_to(engine):
    q = Query((D("id"),), TableRef("doc", "d"), Or((Comparison("=", D("kind"), "nope"), Fuzzy(D("body"), "zzz"))))
    model = next(x.bound_model for x in engine.plan(q).plan.walk() if isinstance(x, ir.SemanticFilter))
    own = Engine(engine.registry, engine.tables, {model: FunctionJudge(lambda contents, text: [True] * len(contents))})
    assert {r[0] for r in own.query(q).collect()} == {"old", "new"}


def test_what_exact_branches_decide_is_not_judged(engine, spark):
    def judge(contents, text):
        assert not any("slept" in c for c in contents)
        return [False for _ in contents]

    own = Engine(engine.registry, engine.tables, {"*": FunctionJudge(judge)})
    assert ids(own, Or((Comparison("=", D("id"), "old"), Fuzzy(D("body"), "x")))) == {"old"}


def test_evidence_of_collections_and_collapse(engine):
    q = Query((D("id"),), TableRef("doc", "d"), Fuzzy(Unnest(D("talk")), "harbor"))
    assert [e.quote for r in python_engine(engine).run(q, evidence=True).frame.collect() for e in r.evidence] == ["harbor"]
    plan = engine.plan(q).plan
    sem = next(x for x in plan.walk() if isinstance(x, ir.SemanticFilter))
    got = engine.execute(ir.to_json(ir.edit(plan, sem.node_id, early_exit=False)), evidence=True).frame.collect()
    assert [(r[0], [e.quote for e in r.evidence]) for r in got] == [("old", ["harbor"])]


def test_the_least_sure_go_to_the_oracle(engine):
    q = Query((D("id"),), TableRef("doc", "d"), Fuzzy(D("body"), "harbor"))
    own = python_engine(engine)
    own.judges["oracle"] = FunctionJudge(lambda contents, text: ["slept" in c for c in contents])
    plan = own.plan(q).plan
    sem = next(x for x in plan.walk() if isinstance(x, ir.SemanticFilter))
    run = lambda f: {r[0] for r in own.execute(ir.edit(plan, sem.node_id, escalation_fraction=f)).frame.collect()}
    assert run(None) == {"old", "new"} and run(1.0) == {"old"}


def test_semantic_join_is_judged(engine):
    scan = lambda a: ir.Scan(f"scan_{a}", TableRef("doc", a))
    a, b = FieldRef("a", ("body",)), FieldRef("b", ("body",))
    plan = lambda text: ir.Project("p", (FieldRef("a", ("id",)), FieldRef("b", ("id",))), ir.SemanticJoin("j", scan("a"), scan("b"), a, b, text, 5))
    pairs = lambda text: {tuple(r) for r in engine.execute(plan(text)).frame.collect()}
    assert pairs("") == {(x, y) for x in ("old", "new") for y in ("old", "new")}
    assert pairs("slept") == pairs("") - {("new", "new")}


def test_three_modalities_are_refined_ordered_and_cheaper():
    s = FieldSpec
    doc = {("id",): s("id"), ("org",): s("org"), ("body",): s("body", "TEXT", embeddable=True), ("scan",): s("scan", "IMAGE_SET", "page", 40), ("talk",): s("talk", "AUDIO", "segment", 100, parts=SEGMENTS), ("issued",): s("issued", "DATE")}
    reg = Registry("three", [TableSpec("doc", ("id",), doc), TableSpec("org", ("id",), {("id",): s("id")})], [(("doc", ("org",)), ("org", ("id",)))])
    source = Join(Comparison("=", D("org"), FieldRef("o", ("id",))), TableRef("doc", "d"), TableRef("org", "o"))
    where = And((Comparison("=", FieldRef("o", ("id",)), "ca9"), Comparison(">=", D("issued"), Date("2015-01-01")), Fuzzy(D("body"), "a bond"), Fuzzy(Unnest(D("scan")), "a photo"), Fuzzy(Unnest(D("talk")), "a concession")))
    q = Query((D("id"),), source, where)
    assert checks.validate(q, reg) == []
    planned = planner.optimize(q, reg)
    assert not planned.blocked and len(ir.pipeline(planned.plan)[0].pushed) == 2
    judged = [x for x in ir.pipeline(planned.plan) if isinstance(x, ir.SemanticFilter)]
    assert {x.judgement for x in judged} == {"SEM", "VISUAL", "AUDIO"} and sum(x.early_exit for x in judged) == 2
    est = cost.Estimator(cost.Stats(rows={"doc": 32_000}))
    naive = planner.bind(planned.snapshots["lowered"], est)[0]
    calls = lambda p: sum(x.model_calls for x in est.funnel(p))
    assert calls(planned.plan) < calls(naive)

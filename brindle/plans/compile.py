"""Plans to DataFrames.

Every FROM alias contributes its columns as `alias$column`, only those the plan reads. Exact
predicates are where-clauses directly above the joins, so they reach the scans. A judged expansion
whose elements nobody sees compiles to exists(): no row is multiplied, and the first hit ends it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.lang import nodes as n
from brindle.operators import derive
from brindle.operators.judge import Judge, KeywordJudge, escalate
from brindle.operators.retrieve import nearest, token_overlap
from brindle.operators.semjoin import blocked_join
from brindle.plans import ir
from brindle.plans.planner import shared


@dataclass
class Context:
    tables: dict[str, DataFrame]
    judges: dict[str, Judge] = field(default_factory=dict)
    vectors: dict[str, list[float]] = field(default_factory=dict)
    evidence: bool = False
    observe: bool = False
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    observations: dict[str, Observation] = field(default_factory=dict)

    @property
    def oracle(self) -> Judge | None:
        """The judge that decides what the others are least sure of."""
        return self.judges.get("oracle")

    def judge(self, model: str) -> Judge:
        return self.judges.get(model) or self.judges.get("*") or KeywordJudge()


def _name(ref: n.FieldRef) -> str:
    return f"{ref.source}${'.'.join(ref.path[:1])}"


class Compiler:
    def __init__(self, ctx: Context, plan: ir.Plan):
        self.ctx, self.plan = ctx, plan
        self.made: dict[n.FieldRef, Column] = {}
        self.expanded: dict[n.FieldRef, str] = {}
        #: Inside an OR: the planned judgement of each (field, text), and which rows need judging.
        self.branches: dict[tuple[n.FieldRef, str], ir.SemanticFilter] = {}
        self.open: Column | None = None
        used = {r for x in plan.walk() for r in _refs_of(x)}
        self.used: dict[str, set[str]] = {}
        for r in used:
            self.used.setdefault(r.source, set()).update(r.path[:1] or ["*"])

    # ---- expressions

    def column(self, e: Any, df: DataFrame) -> Column:
        match e:
            case n.Date(value):
                return F.lit(value).cast("timestamp_ntz")
            case n.FieldRef():
                if e in self.made:
                    return self.made[e]
                if not e.path:
                    mine = [c for c in df.columns if c.startswith(f"{e.source}$")]
                    return F.struct(*(F.col(f"`{c}`").alias(c.split("$", 1)[1]) for c in mine))
                c = F.col(f"`{_name(e)}`")
                for step in e.path[1:]:
                    c = c[step]
                return c
            case n.Unnest(ref, path):
                c = F.col(f"`{self.expanded[ref]}`")
                for step in path:
                    c = c[step]
                return c
            case n.Aggregator(op, arg):
                if arg is None:
                    return F.count(F.lit(1))
                return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](self.column(arg, df))
        return F.lit(e)

    def _type(self, c: Column, df: DataFrame) -> T.DataType:
        return df.select(c.alias("x")).schema["x"].dataType

    def pair(self, a: Any, b: Any, df: DataFrame) -> tuple[Column, Column]:
        """Both sides of a comparison: the literal takes the column's type, else both are texts."""
        ca, cb = self.column(a, df), self.column(b, df)
        if isinstance(a, (n.FieldRef, n.Unnest)) and not isinstance(b, (n.FieldRef, n.Unnest)):
            kind = self._type(ca, df)
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
            return ca, self.literal(b, kind, cb)
        if isinstance(b, (n.FieldRef, n.Unnest)) and not isinstance(a, (n.FieldRef, n.Unnest)):
            kind = self._type(cb, df)
            return self.literal(a, kind.elementType if isinstance(kind, T.ArrayType) else kind, ca), cb
        ka, kb = self._type(ca, df), self._type(cb, df)
        if isinstance(ka, T.StringType) != isinstance(kb, T.StringType) and not isinstance(ka, T.ArrayType) and not isinstance(kb, T.ArrayType):
            return ca.cast("string"), cb.cast("string")
        return ca, cb

    @staticmethod
    def literal(v: Any, kind: T.DataType, as_is: Column) -> Column:
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(v.value if isinstance(v, n.Date) else str(v)).try_cast("timestamp_ntz")
        if isinstance(kind, T.NumericType):
            return F.lit(v) if isinstance(v, (int, float)) else F.lit(str(v)).try_cast("double")
        if isinstance(kind, T.BooleanType):
            return F.lit(v) if isinstance(v, bool) else F.lit(str(v)).try_cast("boolean")
        return F.lit(v if isinstance(v, str) else v.value if isinstance(v, n.Date) else str(v))

    def condition(self, c: Any, df: DataFrame) -> Column:
        match c:
            case n.And(children):
                return _fold(children, lambda x: self.condition(x, df), lambda a, b: a & b)
            case n.Or(children):
                return self.any_of(children, df)
            case n.Not(n.Fuzzy() as fuzzy):
                return self.branch(fuzzy, True, df)
            case n.Not(child):
                return ~self.condition(child, df)
            case n.Comparison(op, a, b):
                x, y = self.pair(a, b, df)
                if isinstance(a, n.FieldRef) and isinstance(self._type(x, df), T.ArrayType):
                    return F.array_contains(x, y) if op == "=" else ~F.array_contains(x, y)
                if isinstance(b, n.FieldRef) and isinstance(self._type(y, df), T.ArrayType):
                    return F.array_contains(y, x) if op == "=" else ~F.array_contains(y, x)
                return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            case n.InList(f, values):
                x = self.column(f, df)
                kind = self._type(x, df)
                if isinstance(kind, T.ArrayType):
                    return F.arrays_overlap(x, F.array(*(self.literal(v, kind.elementType, F.lit(None)) for v in values)))
                return x.isin(*(self.literal(v, kind, self.column(v, df)) for v in values))
            case n.Between(f, low, high):
                x, a = self.pair(f, low, df)
                _, b = self.pair(f, high, df)
                return x.between(a, b)
            case n.Like(f, pattern):
                x = self.column(f, df)
                if isinstance(self._type(x, df), T.ArrayType):
                    return F.exists(x, lambda e: e.ilike(pattern))
                return x.ilike(pattern)
            case n.Fuzzy():
                return self.branch(c, False, df)
        raise TypeError(f"not a condition: {c!r}")

    def branch(self, c: n.Fuzzy, negated: bool, df: DataFrame) -> Column:
        """A judgement inside an OR, by the judge and quantifier planned for it."""
        over = isinstance(c.field, n.Unnest)
        ref = c.field.ref if over else c.field
        plan = self.branches.get((ref, c.text))
        judge = self.ctx.judge(plan.bound_model if plan else "*")
        if over:
            return judge.some(self.full(ref, df), c.text, not negated)
        return self.judged(ref, c.text, judge, plan.quantifier if plan else "ANY", negated, df)

    def any_of(self, children: tuple, df: DataFrame) -> Column:
        """An OR: exact branches first; what they, or earlier judgements, decide is not judged: its
        content is null for the judge."""
        exact = [c for c in children if not any(isinstance(p, n.Fuzzy) for p in n.predicates(c))]
        fuzzy = [c for c in children if c not in exact]
        out = _fold(exact, lambda x: F.coalesce(self.condition(x, df), F.lit(False)), lambda a, b: a | b) if exact else None
        outer = self.open
        for c in fuzzy:
            need = None if out is None else ~out
            self.open = need if outer is None else outer if need is None else outer & need
            v = F.coalesce(self.condition(c, df), F.lit(False))
            out = v if out is None else out | v
        self.open = outer
        return out

    # ---- judgements

    def content(self, ref: n.FieldRef, df: DataFrame) -> Column:
        c = self.column(ref, df)
        kind = self._type(c, df)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            c = F.transform(c, lambda e: e["text"])
        elif isinstance(kind, T.StructType):
            c = c["text"]
        return c if self.open is None else F.when(self.open, c)

    def full(self, ref: n.FieldRef, df: DataFrame) -> Column:
        """A collection's elements that hold anything."""
        return F.filter(self.content(ref, df), lambda e: F.length(F.trim(e)) > 0)

    def judged(self, ref: n.FieldRef, text: str, judge: Judge, quantifier: str, negated: bool, df: DataFrame) -> Column:
        """The row's verdict: over a collection, that of its elements by the field's quantifier."""
        c = self.content(ref, df)
        if isinstance(self._type(c, df), T.ArrayType):
            full = self.full(ref, df)
            if quantifier == "ALL":
                hit = (F.size(full) > 0) & judge.every(full, text)
            else:
                hit = F.when(F.size(full) > 0, judge.some(full, text))
            return ~hit if negated else hit
        hit = judge.column(c, text)
        return ~hit if negated else hit

    # ---- operators

    def run(self) -> DataFrame:
        return self.node(self.plan)

    def node(self, p: ir.Plan) -> DataFrame:
        df = getattr(self, "_" + re.sub(r"(?<!^)(?=[A-Z])", "_", type(p).__name__).lower())(p)
        if self.ctx.observe:
            seen = Observation()
            self.ctx.observations[p.node_id] = seen  # type: ignore[attr-defined]
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        return df

    def _table(self, ref: n.TableRef) -> DataFrame:
        df = self.ctx.tables[ref.name]
        want = self.used.get(ref.alias, set())
        cols = [c for c in df.columns if c in want or "*" in want] or df.columns[:1]
        return df.select(*(F.col(f"`{c}`").alias(f"{ref.alias}${c}") for c in cols))

    def _source(self, s: Any) -> DataFrame:
        if isinstance(s, n.TableRef):
            return self._table(s)
        left, right = self._source(s.left), self._source(s.right)
        a, b = s.condition.field1, s.condition.field2
        if a.source in n.aliases(s.right):
            a, b = b, a
        x, y = self.column(a, left), self.column(b, right)
        if isinstance(self._type(x, left), T.StringType) != isinstance(self._type(y, right), T.StringType):
            x, y = x.cast("string"), y.cast("string")
        return left.join(right, x == y, "inner")

    def _scan(self, p: ir.Scan) -> DataFrame:
        df = self._source(p.source)
        for c in p.pushed:
            df = df.where(self.condition(c, df))
        return df

    def _exact_filter(self, p: ir.ExactFilter) -> DataFrame:
        df = self.node(p.child)
        return df.where(self.condition(p.condition, df))

    def _materialize(self, p: ir.Materialize) -> DataFrame:
        df = self.node(p.child)
        made = derive.METHODS[p.method](self.column(p.source, df))
        df = df.withColumn(_name(p.produces), made)
        c = F.col(f"`{_name(p.produces)}`")
        # coverage: a row without the derived field can't satisfy what reads it
        return df.where(F.size(c) > 0) if isinstance(self._type(c, df), T.ArrayType) else df.where(F.length(c) > 0)

    def _retrieve(self, p: ir.Retrieve) -> DataFrame:
        df = self.node(p.child)
        # ties go by everything else a row shows, so they are stable
        keys = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and f.name != _name(p.field)]
        vector = self.ctx.vectors.get(p.text)
        top = nearest(df, self.column(p.field, df), vector, p.top_k, keys) if vector is not None else token_overlap(df, self.column(p.field, df), p.text, p.top_k, keys)
        judge = self.ctx.judges.get(p.rerank_model)
        if judge is not None:
            # the k rows, the reranker's surest first
            top = top.withColumn("_rerank", judge.confidence(self.content(p.field, top), p.text)).orderBy(F.desc_nulls_last("_rerank"), F.desc("score"), *keys).drop("_rerank")
        return top.drop("score")

    def _expand(self, p: ir.Expand) -> DataFrame:
        df = self.node(p.child)
        name = f"{p.field}#element"
        self.expanded[p.field] = name
        keep = [F.col(f"`{c}`") for c in df.columns]
        return df.select(*keep, F.posexplode(self.column(p.field, df)).alias("_ord", name))

    def _semantic_filter(self, p: ir.SemanticFilter) -> DataFrame:
        judge = self.ctx.judge(p.bound_model)
        seen = p.elements and not p.early_exit
        if seen:
            df = self.node(p.child)
            c = F.col(f"`{self.expanded[p.field]}`")
            c = c["text"] if isinstance(self._type(c, df), T.StructType) else c
            hit = judge.column(c, p.text)
            df = df.where(~hit if p.negated else hit)
        elif p.elements:
            # the expansion below is not built: some element meets, or fails, the judgement
            df = self.node(p.child.child)
            df = df.where(judge.some(self.full(p.field, df), p.text, not p.negated))
            c = self.content(p.field, df)
        else:
            df = self.node(p.child)
            hit = self.judged(p.field, p.text, judge, p.quantifier, p.negated, df)
            second, c = self.ctx.oracle, self.content(p.field, df)
            if p.escalation_fraction and second is not None and not isinstance(self._type(c, df), T.ArrayType):
                again = self.judged(p.field, p.text, second, p.quantifier, p.negated, df)
                df = escalate(df, hit, again, judge.confidence(c, p.text), p.escalation_fraction).where("verdict").drop("verdict")
            else:
                df = df.where(hit)
            c = self.content(p.field, df)
        return self._attach(df, c, judge, p) if self.ctx.evidence else df

    def _attach(self, df: DataFrame, c: Column, judge: Judge, p: ir.SemanticFilter) -> DataFrame:
        if isinstance(self._type(c, df), T.ArrayType):
            c = judge.first(F.filter(c, lambda e: F.length(F.trim(e)) > 0), p.text)
        sure = judge.confidence(c, p.text)
        one = F.struct(F.lit(str(p.field)).alias("label"), F.left(c, F.lit(200)).alias("quote"), sure.alias("confidence"))
        before = F.col("_evidence") if "_evidence" in df.columns else F.array().cast("array<struct<label:string,quote:string,confidence:double>>")
        return df.withColumn("_evidence", F.array_append(before, one))

    def _collapse(self, p: ir.Collapse) -> DataFrame:
        below = p.child
        df = self.node(below)
        if isinstance(below, ir.SemanticFilter) and below.early_exit:
            return df
        # a row is what it was before the expansion; two hashes stand for it, so no text is a key
        keys = [F.col(f"`{c}`") for c in df.columns if "#element" not in c and c not in ("_ord", "_evidence")]
        rows = df.withColumn("_row", F.struct(F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)))
        first = rows.groupBy("_row").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.col("_ord")).alias("_first"))
        kept = [c for c in df.columns if "#element" not in c and c != "_ord"]
        return first.select(*(F.col("_first")[c].alias(c) for c in kept))

    def _union(self, p: ir.Union) -> DataFrame:
        """Branches share everything below the OR: one pass with a masked condition, nothing to dedup."""
        base = shared(p)
        df = self.node(base)
        self.branches |= {(x.field, x.text): x for c in p.children for x in c.walk() if isinstance(x, ir.SemanticFilter)}
        return df.where(self.condition(p.condition, df))

    def _aggregate(self, p: ir.Aggregate) -> DataFrame:
        df = self.node(p.child)
        keys = [self.column(g, df).alias(str(g)) for g in p.group_by]
        # sums of integers stay integers, averages are doubles
        vals = [self.column(a, df).alias(str(a)) for a in p.aggregators]
        if not vals:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*vals) if keys else df.agg(*vals)

    def _limit(self, p: ir.Limit) -> DataFrame:
        return self.node(p.child).limit(p.k)

    def _project(self, p: ir.Project) -> DataFrame:
        df = self.node(p.child)
        counted = any(isinstance(x, ir.Aggregate) for x in ir.pipeline(p))
        cols = []
        for e in p.columns:
            label = str(e) if isinstance(e, n.Node) else n.shown(e)
            cols.append((F.col(f"`{label}`") if counted else self.column(e, df)).alias(label))
        if self.ctx.evidence and "_evidence" in df.columns:
            cols.append(F.col("_evidence").alias("evidence"))
        return df.select(*cols)

    def _semantic_join(self, p: ir.SemanticJoin) -> DataFrame:
        """Pairs that share most words, of which the judge keeps those that the text fits together."""
        left, right = self.node(p.left), self.node(p.right)
        a, b = left.columns[0], right.columns[0]
        pairs = blocked_join(left, right, self.content(p.left_field, left), self.content(p.right_field, right), a, b, p.block_top_k)
        both = left.join(pairs, a).join(right, b).withColumnRenamed("shared", "_shared")
        if p.text.strip():
            said = F.concat_ws("\n", self.content(p.left_field, both), self.content(p.right_field, both))
            both = both.where(self.ctx.judge(p.model).column(said, p.text))
        return both


def _fold(items, f, join):
    out = None
    for x in items:
        v = f(x)
        out = v if out is None else join(out, v)
    return out


def _refs_of(p: ir.Plan) -> list[n.FieldRef]:
    match p:
        case ir.Scan():
            return [r for c in (*n.join_conditions(p.source), *p.pushed) for r in n.field_refs(c)]
        case ir.ExactFilter() | ir.Union():
            return n.field_refs(p.condition)
        case ir.SemanticFilter() | ir.Expand() | ir.Retrieve():
            return [p.field]
        case ir.Materialize():
            return [p.source]
        case ir.Aggregate():
            return [r for e in (*p.group_by, *p.aggregators) for r in n.field_refs(e)]
        case ir.Project():
            return [r for e in p.columns for r in n.field_refs(e)]
        case ir.SemanticJoin():
            return [p.left_field, p.right_field]
    return []

"""The engine: a wire query, or a tree, in; a DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from brindle.catalog.registry import Registry
from brindle.catalog.testdata import KEYS, testdata_registry
from brindle.lang import checks, typecheck, wire
from brindle.lang import nodes as n
from brindle.operators.judge import Judge
from brindle.plans import cost, ir, planner
from brindle.plans.compile import Compiler, Context
from brindle.session import read


class QueryRejected(ValueError):
    def __init__(self, errors: list[dict[str, str]]):
        super().__init__("; ".join(e["message"] for e in errors))
        self.errors = errors


@dataclass
class Result:
    frame: DataFrame
    plan: ir.Plan
    warnings: list[dict[str, str]]
    estimate: list[cost.Stage]
    context: Context
    printed: str = ""

    def funnel(self) -> list[dict[str, Any]]:
        """Rows out of each operator, after the frame has been run with observe=True."""
        out = []
        before: dict[str, int] = {}
        for p in reversed(list(self.plan.walk())):
            seen = self.context.observations.get(p.node_id)  # type: ignore[attr-defined]
            if seen is None:
                continue
            rows = int(seen.get["rows"])
            before[p.node_id] = rows  # type: ignore[attr-defined]
            into = sum(before.get(c.node_id, rows) for c in p.inputs) if p.inputs else rows  # type: ignore[attr-defined]
            out.append({"node_id": p.node_id, "label": ir.label(p), "rows_in": into, "rows_out": rows, "model_calls": into if isinstance(p, ir.SemanticFilter) else 0})  # type: ignore[attr-defined]
        return out


@dataclass
class Engine:
    registry: Registry
    tables: dict[str, DataFrame]
    judges: dict[str, Judge] = field(default_factory=dict)
    vectors: dict[str, list[float]] = field(default_factory=dict)
    estimator: cost.Estimator = field(default_factory=cost.Estimator)

    def check(self, wire_query: Any) -> list[dict[str, str]]:
        """Everything wrong with a wire query: its form, its names, its types."""
        bad = wire.decode_errors(wire_query)
        if bad:
            return [e.as_dict() for e in bad]
        q = wire.decode(wire_query)
        out = checks.validate(q, self.registry)
        if not out:
            try:
                typecheck.check_query(q, self.registry.types())
            except typecheck.TypeFailure as e:
                out.append({"code": "type_error", "message": str(e)})
        return out

    def plan(self, query: Any, probe: bool = False) -> planner.Planned:
        q = query if isinstance(query, n.Query) else wire.decode(query)
        bad = self.check(wire.encode(q))
        if bad:
            raise QueryRejected(bad)
        rows = self.tables[n.tables(q.source)[0].name].count() if probe else None
        return planner.optimize(q, self.registry, self.estimator, self._prober() if probe else None, rows)

    def _prober(self) -> Callable:
        def count(source, pushed) -> int:
            scan = ir.Scan("probe", source, pushed)
            return Compiler(Context(self.tables), scan).run().count()

        return count

    def execute(self, plan: ir.Plan | dict, evidence: bool = False, observe: bool = False, warnings: list | None = None) -> Result:
        """A plan, or its JSON form, run as it is."""
        p = ir.from_json(plan) if isinstance(plan, dict) else plan
        ctx = Context(self.tables, self.judges, self.vectors, evidence, observe)
        return Result(Compiler(ctx, p).run(), p, warnings or [], self.estimator.funnel(p), ctx)

    def query(self, query: Any, **options) -> DataFrame:
        return self.run(query, **options).frame

    def run(self, query: Any, evidence: bool = False, observe: bool = False, probe: bool = False) -> Result:
        q = query if isinstance(query, n.Query) else wire.decode(query)
        planned = self.plan(q, probe)
        result = self.execute(planned.plan, evidence, observe, planned.warnings)
        result.printed = str(q)
        return result


def testdata_engine(spark: SparkSession, root: str, only: tuple[str, ...] | None = None) -> Engine:
    """An engine over the project's tables, or over some of them: only their files are opened."""
    frames = {name: read(spark, root, name) for name in only or KEYS}
    return Engine(testdata_registry(spark, root, frames), frames)

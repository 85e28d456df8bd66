"""What the engine knows of its tables: keys, fields with modality, join edges.

A registry is derived from Spark schemas plus an overlay (modality, fan-out, derivations, edges), or
read from its JSON form.
"""

from __future__ import annotations

import difflib
import json
from collections import deque
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path as File
from typing import Any

from pyspark.sql import types as T

from brindle.lang import types as lt

Path = tuple[str, ...]

FIELD_TYPES = ("SCALAR", "DATE", "TEXT", "TEXT_CHUNKED", "IMAGE_SET", "AUDIO", "DOC_SCAN")
DERIVATIONS = ("RASTERIZE", "DOC_PARSE", "ASR", "CHUNK")
#: Which predicates a field's type admits.
ADMITS = {"compare": ("SCALAR", "DATE", "TEXT"), "fuzzy": ("TEXT", "TEXT_CHUNKED", "IMAGE_SET", "AUDIO", "DOC_SCAN")}
#: The judgement a field's type asks for.
JUDGEMENT = {"TEXT": "SEM", "TEXT_CHUNKED": "SEM", "DOC_SCAN": "SEM", "IMAGE_SET": "VISUAL", "AUDIO": "AUDIO"}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "SCALAR"
    unit: str = "row"
    fanout: float = 1
    quantifier: str = "ANY"
    derivation: str | None = None
    source_field: str | None = None
    embeddable: bool = False
    index: str | None = None
    value: str = "text"  # of scalars: text, int, float, bool
    parts: tuple[tuple[str, str], ...] = ()  # of elements that are records: names and values

    @property
    def set_valued(self) -> bool:
        return self.fanout > 1 or self.unit != "row"

    def admits(self, predicate: str) -> bool:
        return self.type in ADMITS[predicate]

    @property
    def access(self) -> str:
        """The index a field has unless it names one."""
        if self.index:
            return self.index
        if self.type in ("SCALAR", "DATE"):
            return "btree"
        return ("fts" if self.embeddable else "nocase") if self.type == "TEXT" else "none"


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: Path
    fields: dict[Path, FieldSpec] = field(default_factory=dict)


class RegistryError(ValueError):
    pass


class Registry:
    def __init__(self, name: str, tables: Iterable[TableSpec], edges: Iterable[tuple[tuple[str, Path], tuple[str, Path]]] = ()):
        self.name = name
        self.tables = {t.name: t for t in tables}
        self.edges = [(a, b) for a, b in edges]
        for spec in self.tables.values():
            for f in spec.fields.values():
                if f.type not in FIELD_TYPES or f.derivation not in (None, *DERIVATIONS) or f.quantifier not in ("ANY", "ALL"):
                    raise RegistryError(f"{spec.name}.{f.name} is not a valid field")
        for side in (s for e in self.edges for s in e):
            if side[0] not in self.tables or self.field(*side) is None:
                raise RegistryError(f"edge end {side} names no field")

    def field(self, table: str, path: Path) -> FieldSpec | None:
        return self.tables[table].fields.get(tuple(path)) if table in self.tables else None

    def field_names(self, table: str) -> list[str]:
        return [".".join(p) for p in self.tables[table].fields] if table in self.tables else []

    def has_edge(self, a: tuple[str, Path], b: tuple[str, Path]) -> bool:
        return (a, b) in self.edges or (b, a) in self.edges

    @staticmethod
    def suggest(name: str, known: Iterable[str]) -> str:
        near = difflib.get_close_matches(name, list(known), 1, 0.6)
        return f", did you mean {near[0]!r}?" if near else ""

    def join_path(self, start: str, goal: str) -> list[tuple[tuple[str, Path], tuple[str, Path]]] | None:
        """The fewest edges from one table to another, each directed along the way."""
        back: dict[str, Any] = {start: None}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            if at == goal:
                break
            for a, b in self.edges:
                for x, y in ((a, b), (b, a)):
                    if x[0] == at and y[0] not in back:
                        back[y[0]] = (at, (x, y))
                        queue.append(y[0])
        if goal not in back:
            return None
        steps = []
        while back[goal] is not None:
            goal, step = back[goal]
            steps.append(step)
        return steps[::-1]

    def types(self) -> dict[str, lt.Record]:
        """The structural type of each table."""
        return {name: _record({p: _lang_type(f) for p, f in t.fields.items()}) for name, t in self.tables.items()}

    def to_dict(self) -> dict[str, Any]:
        return {
            "name": self.name,
            "tables": [{"name": t.name, "key": list(t.key), "fields": [{"path": list(p), **{k: v for k, v in asdict(f).items() if k != "name"}} for p, f in t.fields.items()]} for t in self.tables.values()],
            "edges": [[[a[0], list(a[1])], [b[0], list(b[1])]] for a, b in self.edges],
        }

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Registry:
        tables = [TableSpec(t["name"], tuple(t["key"]), {tuple(f["path"]): FieldSpec(name=".".join(f["path"]), **{k: tuple(map(tuple, v)) if k == "parts" else v for k, v in f.items() if k != "path"}) for f in t["fields"]}) for t in d["tables"]]
        return cls(d["name"], tables, [((a[0], tuple(a[1])), (b[0], tuple(b[1]))) for a, b in d.get("edges", [])])

    @classmethod
    def load(cls, path: str) -> Registry:
        return cls.from_dict(json.loads(File(path).read_text()))

    def prompt(self) -> str:
        """The registry as text for a model's prompt."""
        lines = []
        for t in self.tables.values():
            lines.append(f"{t.name} (key {'.'.join(t.key)})")
            lines += [f"  {'.'.join(p)}: {f.type}{f' x{f.fanout:g} {f.unit}' if f.set_valued else ''}" for p, f in t.fields.items()]
        return "\n".join([*lines, *(f"{a[0]}.{'.'.join(a[1])} = {b[0]}.{'.'.join(b[1])}" for a, b in self.edges)])


def _lang_type(f: FieldSpec):
    kinds = {"int": lt.INT, "float": lt.FLOAT, "bool": lt.BOOL, "offset": lt.OFFSET}
    if f.parts:
        return lt.Collection(lt.Record(tuple((name, kinds.get(kind, lt.TEXT)) for name, kind in f.parts)), f.derivation is not None)
    base = {"DATE": lt.DATE, "IMAGE_SET": lt.IMAGE, "AUDIO": lt.AUDIO}.get(f.type) or kinds.get(f.value, lt.TEXT)
    return lt.Collection(base, f.derivation is not None) if f.set_valued else lt.Maybe(base)


def _record(fields: dict[Path, Any]) -> lt.Record:
    """Nested records from dotted paths."""
    out: dict[str, Any] = {}
    nested: dict[str, dict[Path, Any]] = {}
    for path, kind in fields.items():
        if len(path) == 1:
            out[path[0]] = kind
        else:
            nested.setdefault(path[0], {})[path[1:]] = kind
    return lt.Record((*out.items(), *((k, _record(v)) for k, v in nested.items() if k not in out)))


def table_from_schema(name: str, key: str, schema: T.StructType, **overlay: FieldSpec) -> TableSpec:
    """A table's spec from its Spark schema; overlay holds the fields that need more than their type."""
    fields: dict[Path, FieldSpec] = {}

    def add(path: Path, dtype: T.DataType) -> None:
        dotted = ".".join(path)
        kind = lt.from_spark(dtype)
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                add((*path, f.name), f.dataType)
        elif isinstance(kind, lt.Collection):
            inner = kind.of.kind if isinstance(kind.of, lt.Scalar) else "text"
            fields[path] = FieldSpec(dotted, unit="item", fanout=4, value=inner)
        else:
            fields[path] = FieldSpec(dotted, "DATE" if kind == lt.DATE else "SCALAR", value=kind.kind if kind != lt.DATE else "text")

    for f in schema.fields:
        add((f.name,), f.dataType)
    for dotted, spec in overlay.items():
        fields[tuple(dotted.split("."))] = spec
    return TableSpec(name, tuple(key.split(".")), fields)

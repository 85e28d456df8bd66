"""The physical layer: what each declared field becomes, and the derived tables kept for it.

Nested scalars become generated columns, arrays and maps side tables, embeddable texts an inverted index. The
plan is derived from the Spark schema and the registry; apply() writes what it names, and does nothing
for parts whose source hasn't changed since.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.catalog.registry import TableSpec
from brindle.sources import store as tables


@dataclass(frozen=True)
class Home:
    """Where a field lives: a column of the table, a generated column, a side table, or nowhere."""

    field: str
    home: str  # column, generated, array, map, tokens, unmapped
    index: str  # minmax, bloom, tokens, none
    reason: str


def resolve(schema: T.StructType, path: tuple[str, ...]) -> T.DataType | None:
    """The type at a nested path; arrays are not walked into."""
    at: T.DataType = schema
    for step in path:
        if not isinstance(at, T.StructType) or step not in at.names:
            return None
        at = at[step].dataType
    return at


def index_of(kind: str, embeddable: bool, dtype: T.DataType) -> str:
    """The access path a field gets unless it says otherwise: dates and numbers are found by their files'
    minima and maxima, other scalars by bloom filters, embeddable texts by their words."""
    if kind == "DATE" or isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "minmax"
    if kind == "TEXT":
        return "tokens" if embeddable else "none"
    return "bloom" if kind == "SCALAR" and isinstance(dtype, T.StringType) else "none"


def plan(df: DataFrame, spec: TableSpec) -> list[Home]:
    out = []
    for path, f in spec.fields.items():
        name, dtype = ".".join(path), resolve(df.schema, path)
        if dtype is None:
            out.append(Home(name, "unmapped", "none", f"derived by {f.derivation}" if f.derivation else "no such path"))
        elif isinstance(dtype, T.ArrayType):
            out.append(Home(name, "array", "bloom", "one row for each element"))
        elif isinstance(dtype, T.MapType):
            out.append(Home(name, "map", "bloom", "one row for each key"))
        elif isinstance(dtype, T.StructType):
            out.append(Home(name, "unmapped", "none", "a record; its parts have homes of their own"))
        else:
            out.append(Home(name, "column" if len(path) == 1 else "generated", index_of(f.type, f.embeddable, dtype), f.type.lower()))
    return out


def generated(df: DataFrame, homes: list[Home]) -> DataFrame:
    """The table with a top-level column for each nested scalar, so that filters on it reach the scan."""
    return df.select("*", *(F.col(h.field).alias(h.field.replace(".", "__")) for h in homes if h.home == "generated"))


def derived(df: DataFrame, key: str, homes: list[Home]) -> dict[str, DataFrame]:
    """The side tables and word indexes that the plan names."""
    make = {"array": tables.unnested, "map": tables.pairs}
    out = {f"{h.field}__{h.home}": make[h.home](df, key, h.field) for h in homes if h.home in make}
    return out | {f"{h.field}__tokens": tables.token_index(df, key, h.field) for h in homes if h.index == "tokens"}


def apply(store: tables.Store, table: str, spec: TableSpec, key: str, rebuild: bool = False) -> list[str]:
    """Write the derived tables of a stored table; those of the version already derived from are left,
    unless a rebuild is asked for. The names written."""
    df, version = store.read(table), str((store._versions(table) or [0])[-1])
    if df is None:
        return []
    done = []
    for name, side in derived(df, key, plan(df, spec)).items():
        full = f"{table}__{name.replace('.', '_')}"
        if rebuild or store.cursor(f"derived:{full}") != version:
            store.overwrite(full, side)
            store.checkpoint(f"derived:{full}", version, 0)
            done.append(full)
    return done


def describe(df: DataFrame, spec: TableSpec) -> str:
    return "\n".join(f"{h['field']}: {h['home']}, index {h['index']} ({h['reason']})" for h in map(asdict, plan(df, spec)))


def index_options(homes: list[Home]) -> dict[str, str]:
    """Options of the Parquet writer for the planned bloom filters."""
    return {f"parquet.bloom.filter.enabled#{h.field}": "true" for h in homes if h.index == "bloom" and h.home in ("column", "generated")}

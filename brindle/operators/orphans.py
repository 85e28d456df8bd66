"""References to records that do not exist.

Every distinct (key, month of loading) of a referencing table is held against the months in
which the key's parents are there, by a left anti-join; the rows or counts come from joining
that small set back. Months are integers (year * 12 + month - 1), so "there at the end of
month m" is an interval test on integers.

Defined results: a null or blank reference is no case; a row without loaded_at has no month
and is no case; a parent without loaded_at is never there; repeated rows each count; an empty
parent table makes every reference an orphan; an empty child table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import numeric_key

#: The heaviest orphan (key, month) groups are joined back by broadcast. The number is the
#: size bound of that broadcast; every other group goes through the shuffled join.
HEAVY_GROUPS = 64


@dataclass(frozen=True)
class Reference:
    """child.fk points at parent.key. deletable: the parent has a deleted_at."""

    table: str
    child: DataFrame
    fk: str
    parent: DataFrame
    key: str
    deletable: bool = True


def _month(ts):
    return F.year(ts) * 12 + F.month(ts) - 1


def _label(month):
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))


def _children(ref: Reference) -> DataFrame:
    return ref.child.select(F.col("row_id").cast("bigint").alias("row_id"), numeric_key(F.col(ref.fk)).alias("k"), _month(F.col("loaded_at")).alias("m")).where("k is not null and m is not null")


def _spans(ref: Reference) -> DataFrame:
    """(k, first, last): months at whose end a parent of key k is there."""
    last = F.coalesce(_month(F.col("deleted_at")) - 1, F.lit(1 << 30)) if ref.deletable else F.lit(1 << 30)
    return ref.parent.select(numeric_key(F.col(ref.key)).alias("pk"), _month(F.col("loaded_at")).alias("first"), last.alias("last")).where("pk is not null and first is not null and first <= last").groupBy("pk", "last").agg(F.min("first").alias("first"))


def _keys(ref: Reference) -> DataFrame:
    """Distinct (k, m) with its row count; partial aggregation runs before the shuffle."""
    return _children(ref).groupBy("k", "m").agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(ref: Reference) -> DataFrame:
    keys, spans = _keys(ref), _spans(ref)
    return keys.join(spans, (keys.k == spans.pk) & keys.m.between(spans["first"], spans["last"]), "left_anti")


def orphan_rows(ref: Reference) -> DataFrame:
    """(ref_table, load_month, row_id) of each referencing row without a target."""
    rows, lost = _children(ref), orphan_keys(ref)
    heavy = lost.orderBy(F.desc("n"), "k", "m").limit(HEAVY_GROUPS).select("k", "m")
    light = lost.join(F.broadcast(heavy), ["k", "m"], "left_anti").select("k", "m")
    of_heavy = rows.join(F.broadcast(heavy), ["k", "m"])
    # rows of heavy groups leave before the shuffle, so no shuffle partition can hold one of them
    of_light = rows.join(F.broadcast(heavy), ["k", "m"], "left_anti").join(light, ["k", "m"])
    return of_heavy.unionByName(of_light).select(F.lit(ref.table).alias("ref_table"), _label(F.col("m")).alias("load_month"), "row_id").distinct()


def orphan_counts(ref: Reference) -> DataFrame:
    """Per month: referencing rows, orphan rows and distinct orphan keys."""
    spans = _spans(ref)
    keys = _keys(ref)
    hit = keys.join(spans, (keys.k == spans.pk) & keys.m.between(spans["first"], spans["last"]), "left_semi").select("k", "m", F.lit(1).alias("hit"))
    seen = keys.join(hit, ["k", "m"], "left")
    return (
        seen.groupBy("m")
        .agg(F.sum("n").cast("bigint").alias("ref_rows"), F.sum(F.when(F.col("hit").isNull(), F.col("n")).otherwise(0)).cast("bigint").alias("orphan_rows"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("bigint").alias("orphan_keys"))
        .select(F.lit(ref.table).alias("ref_table"), _label(F.col("m")).alias("load_month"), "ref_rows", "orphan_rows", "orphan_keys")
    )

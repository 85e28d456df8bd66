"""Tables in files: upserts, checkpoints, derived tables.

A table is a folder of versions, each a manifest of bucket folders. A write puts its files beside the
old ones and then creates the next manifest under a name that must not exist yet: readers see the
whole of one version or of the other, writers that collide fail and may try again, and frames over
an older version stay good until vacuum() removes what no kept version names. Keyed tables are hashed
into BUCKETS by key, and an upsert writes only the buckets that its rows fall into.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import settle, unsettle


def _order(df: DataFrame, by: list[str]):
    """A sort key without nulls, so that null counts as the smallest."""
    return F.struct(*(x for c in by for x in (F.col(c).isNotNull().alias(f"{c}_set"), F.col(c))))


def last_wins(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per key, the last in order. Partial aggregation: a hot key never meets in one task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), _order(df, by)).alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*(F.col(c) for c in by))).alias("_row")).select("_row.*")


# Where a record's date stands, the surest first.
DATES = ("date_issued", "date_filed", "date", "effective_date", "envelope.effective_date")


def date_of(df: DataFrame, *more: str):
    """A record's date: the first of its date fields that is set, then of those named."""
    have = [F.col(c).try_cast("date") for c in (*DATES, *more) if c.split(".")[0] in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("date")


#: Buckets of a keyed table. More buckets: less is written again by a small upsert.
BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer made the next version of the table first."""


class Store:
    """Named tables under one folder, with keyed upserts and load checkpoints."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.folder}/{table}/_versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, table: str, version: int | None = None) -> dict:
        """{keys, parts: {bucket: [folders]}} of the newest, or a given, version; {} for no table."""
        found = self._versions(table)
        if not found:
            return {}
        fs, p = self._fs(f"{self.folder}/{table}/_versions/{found[-1] if version is None else version}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, table: str, before: list[int], manifest: dict) -> None:
        """The next version; fails if another writer has made it."""
        fs, p = self._fs(f"{self.folder}/{table}/_versions/{before[-1] + 1 if before else 1}")
        _, aside = self._fs(f"{self.folder}/{table}/_new-{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.mkdirs(p.getParent())
        if fs.exists(p) or not fs.rename(aside, p):
            fs.delete(aside, False)
            raise ConcurrentWrite(table)

    def _frame(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.folder}/{table}/{x}" for x in parts))

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        m = self._manifest(table, version)
        return self._frame(table, sorted(x for some in m["parts"].values() for x in some)) if m else None

    def overwrite(self, table: str, df: DataFrame) -> None:
        before, name = self._versions(table), f"p-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{table}/{name}")
        self._publish(table, before, {"keys": [], "parts": {"": [name]}})

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """Rows of df replace stored rows of their key; within df the last loaded wins."""
        before, m = self._versions(table), self._manifest(table)
        bucket = F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(BUCKETS)).cast("int")
        fresh = settle(df.withColumn("_seq", F.lit(1)).withColumn("_at", F.monotonically_increasing_id()).withColumn("_bucket", bucket))
        touched = [str(r[0]) for r in fresh.select("_bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            unsettle(fresh)
            return None if m else self.overwrite(table, df)
        keyed = m.get("keys") == keys
        old_parts = [x for b in (touched if keyed else m.get("parts", {})) for x in m["parts"].get(b, [])] if m else []
        both = fresh
        if old_parts:
            old = self._frame(table, old_parts).withColumn("_seq", F.lit(0)).withColumn("_at", F.lit(0).cast("bigint")).withColumn("_bucket", bucket)
            both = fresh.unionByName(old, allowMissingColumns=True)
        name = f"p-{uuid.uuid4().hex}"
        last_wins(both, keys, ["_seq", "_at"]).drop("_seq", "_at").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{table}/{name}")
        unsettle(fresh)
        fs, root = self._fs(f"{self.folder}/{table}/{name}")
        made = {f.getPath().getName().split("=")[1]: [f"{name}/{f.getPath().getName()}"] for f in fs.listStatus(root) if f.isDirectory()}
        parts = ({b: x for b, x in m["parts"].items() if b not in touched} if keyed else {}) | made
        self._publish(table, before, {"keys": keys, "parts": parts})

    def vacuum(self, table: str, keep: int = 1) -> None:
        """Remove all but the newest versions, and files that none of those names."""
        versions = self._versions(table)
        kept = versions[-keep:]
        live = {x.split("/")[0] + ("/" + x.split("/")[1] if "/" in x else "") for v in kept for some in self._manifest(table, v)["parts"].values() for x in some}
        for v in versions[:-keep]:
            fs, p = self._fs(f"{self.folder}/{table}/_versions/{v}")
            fs.delete(p, False)
        fs, root = self._fs(f"{self.folder}/{table}")
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("p-") and not any(x.split("/")[0] == name for x in live):
                fs.delete(f.getPath(), True)

    def append(self, table: str, df: DataFrame) -> None:
        before, m, name = self._versions(table), self._manifest(table), f"p-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{table}/{name}")
        # rows outside of the buckets: the next upsert deals the whole table out again
        parts = {k: list(v) for k, v in m.get("parts", {}).items()}
        parts.setdefault("", []).append(name)
        self._publish(table, before, {"keys": [], "parts": parts})

    def tables(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []

    def list(self, table: str, source_system: str | None = None, limit: int | None = None) -> DataFrame:
        """Rows of a table, of one source system where it is named, in any order."""
        df = self.get(table)
        if source_system is not None:
            where = "envelope.source_system" if "envelope" in df.columns else "source_system"
            df = df.where(F.col(where) == source_system)
        return df.limit(limit) if limit is not None else df

    def clear_all(self) -> None:
        for table in self.tables():
            self.clear(table)

    def get(self, table: str, **key) -> DataFrame:
        df = self.read(table)
        if df is None:
            raise KeyError(table)
        for k, v in key.items():
            df = df.where(F.col(k) == F.lit(v))
        return df

    def count(self, table: str) -> int:
        df = self.read(table)
        return 0 if df is None else df.count()

    def clear(self, table: str) -> None:
        df = self.read(table)
        if df is not None:
            self.overwrite(table, df.limit(0))

    def merge_from(self, other: Store, table: str, keys: list[str]) -> None:
        """A sibling store's table merged into this one."""
        df = other.read(table)
        if df is not None:
            self.upsert(table, df, keys)

    # ---- checkpoints of loads

    def checkpoint(self, lane: str, cursor: str, delta: int) -> None:
        """Where a lane's load has come to, and so many records more."""
        row = self.spark.createDataFrame([(lane, cursor, self.records_done(lane) + delta)], "lane string, cursor string, records_done bigint")
        self.upsert("_checkpoints", row, ["lane"])

    def cursor(self, lane: str) -> str | None:
        df = self.read("_checkpoints")
        row = None if df is None else df.where(F.col("lane") == lane).first()
        return row.cursor if row else None

    def records_done(self, lane: str) -> int:
        df = self.read("_checkpoints")
        row = None if df is None else df.where(F.col("lane") == lane).first()
        return int(row.records_done) if row else 0


# ---- derived tables ------------------------------------------------------------------------


def token_index(df: DataFrame, key: str, body: str) -> DataFrame:
    """(owner_id, token): the inverted index of a text column."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(body), r"[^a-z0-9]+"), lambda w: F.length(w) > 0))
    return df.select(F.col(key).alias("owner_id"), F.explode(tokens).alias("token"))


def unnested(df: DataFrame, key: str, array: str) -> DataFrame:
    """(owner_id, ord, value): the side table of an array column."""
    return df.select(F.col(key).alias("owner_id"), F.posexplode(array).alias("ord", "value"))


def pairs(df: DataFrame, key: str, mapping: str) -> DataFrame:
    """(owner_id, key, value): the side table of a map column."""
    return df.select(F.col(key).alias("owner_id"), F.explode(F.map_entries(mapping)).alias("e")).select("owner_id", "e.key", "e.value")

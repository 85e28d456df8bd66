"""Readers of record files, chosen by suffix; and the sink of normalized records.

Readers don't infer where a schema is given. Bad lines are kept aside in _corrupt, not lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keys under which sources wrap their records.
WRAPPERS = ("results", "bills", "members", "committees", "packages", "agencies", "titles")


class UnknownFormat(ValueError):
    pass


def jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, sample: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines). Blank lines are skipped."""
    if schema is None:  # inferred from a share of the lines, as a full pass would read everything twice
        schema = spark.read.option("mode", "DROPMALFORMED").option("samplingRatio", sample).json(path).schema
        schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = rows.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt is null").select("r.*").drop("_corrupt"), parsed.where("r._corrupt is not null").select(F.col("value").alias("line"))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that is an array of records, one record, or records under a wrapping key."""
    df = spark.read.option("multiLine", True).json(path)
    for key in WRAPPERS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.explode(key).alias("r")).select("r.*")
    return df


def csv(spark: SparkSession, path: str, schema: str | None = None, escape: str = '"', json_cells: tuple[str, ...] = (), multiline: bool = False) -> DataFrame:
    """A CSV with a header; empty cells are null; the named cells hold JSON. Files are split between
    tasks; only where cells hold line breaks (multiline) is each read by one."""
    reader = spark.read.option("header", True).option("nullValue", "").option("escape", escape).option("multiLine", multiline)
    df = (reader.schema(schema) if schema else reader).csv(path)
    for c in json_cells:
        df = df.withColumn(c, F.try_parse_json(F.col(c)))
    return df


def copy_dump(spark: SparkSession, path: str, schema: str | None = None, after: tuple[str, int] | None = None, limit: int | None = None, multiline: bool = True) -> DataFrame:
    """A database's COPY export: backslash escapes, bz2 or plain. `after` (column, value) goes on behind
    a row by its key, whatever order files are read in; limit keeps the next rows by that key."""
    df = csv(spark, path, schema, escape="\\", multiline=multiline)
    if after is not None:
        df = df.where(F.col(after[0]).cast("bigint") > after[1])
    return df if limit is None else (df.orderBy(F.col(after[0]).cast("bigint")) if after is not None else df).limit(limit)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file by its suffix."""
    bare = path.removesuffix(".bz2").removesuffix(".gz")
    if bare.endswith((".jsonl", ".ndjson")):
        return jsonl(spark, path)[0]
    if bare.endswith(".json"):
        return json_document(spark, path)
    if bare.endswith(".csv"):
        return csv(spark, path)
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    raise UnknownFormat(f"no reader for {path!r}")


def write_normalized(entities: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each entity as JSON lines, rows that were set aside under `quarantine`; the report counts what
    was written, by entity, and what was skipped, without a second pass."""
    report = {}
    for name, df in entities.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/{name}")
        report["skipped" if name == "quarantine" else name] = int(seen.get["n"])
    return report

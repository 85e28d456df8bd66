"""Types of the language and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    """text, int, float, bool, date, offset (seconds inside media), image or audio."""

    kind: str

    @property
    def orderable(self) -> bool:
        return self.kind in ("int", "float", "date", "offset")

    @property
    def modal(self) -> bool:
        return self.kind in ("image", "audio")

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float", "offset")


@dataclass(frozen=True)
class Collection:
    """A stored array, or a sequence that a derivation induces."""

    of: object
    derived: bool = False


@dataclass(frozen=True)
class Maybe:
    of: object


@dataclass(frozen=True)
class Record:
    fields: tuple[tuple[str, object], ...]

    def get(self, name: str):
        return dict(self.fields).get(name)


TEXT, INT, FLOAT, BOOL, DATE, OFFSET, IMAGE, AUDIO = map(Scalar, ("text", "int", "float", "bool", "date", "offset", "image", "audio"))


def strip(t):
    """A type without Maybe."""
    return strip(t.of) if isinstance(t, Maybe) else t


def element(t):
    """The element type of a collection, else None."""
    t = strip(t)
    return strip(t.of) if isinstance(t, Collection) else None


def from_spark(dtype: T.DataType, modality: str | None = None):
    if isinstance(dtype, T.ArrayType):
        return Collection(from_spark(dtype.elementType, modality))
    if isinstance(dtype, T.StructType):
        return Record(tuple((f.name, from_spark(f.dataType)) for f in dtype.fields))
    if modality in ("image", "audio"):
        return Scalar(modality)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return TEXT

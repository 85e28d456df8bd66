"""An inner join that no single heavy key can drag down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many of the heaviest keys are joined by broadcast: the size bound of that side.
HEAVY_KEYS = 64
#: A key counts as heavy from so many rows on; below, the shuffled join is cheap enough.
HEAVY_ROWS = 100_000


def hot_join(rows: DataFrame, sized: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with sized, which has one row for each value of keys and, in `size`, how many
    rows carry it. Rows of the heaviest keys meet a broadcast of at most HEAVY_KEYS rows where
    they lie; only the others are shuffled."""
    heavy = sized.where(F.col(size) >= HEAVY_ROWS).orderBy(F.desc(size), *keys).limit(HEAVY_KEYS)
    names = heavy.select(*keys)
    cold = rows.join(F.broadcast(names), keys, "left_anti").join(sized, keys)
    return cold.unionByName(rows.join(F.broadcast(heavy), keys))

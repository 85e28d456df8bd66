"""Derivations: fields that must be made before they can be read. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text

CHUNK = 1000


def chunks(body: Column, size: int = CHUNK) -> Column:
    """Passages of a fixed number of characters; none of an empty or null text."""
    n = F.length(F.coalesce(body, F.lit("")))
    count = F.floor((n + size - 1) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(body, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def spoken(segments: Column) -> Column:
    """Segments' texts in order, joined by blanks."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), " ")


def page_refs(ref: Column, pages: Column) -> Column:
    """References to each page of a scan."""
    return F.transform(F.sequence(F.lit(1), F.greatest(pages, F.lit(1))), lambda i: F.concat(ref, F.lit("#page="), i.cast("string")))


METHODS = {"CHUNK": chunks, "DOC_PARSE": text.strip_html, "ASR": spoken, "RASTERIZE": lambda ref: page_refs(ref, F.lit(1))}

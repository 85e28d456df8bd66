"""Deterministic ids: UUID version 5 without a UDF."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of this engine's ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "brindle:records")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """uuid.uuid5(namespace, name), null for a null name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(F.bitwise_and(digit, F.lit(3)).bitwiseOR(F.lit(8)))) if hasattr(F, "bitwise_and") else F.lower(F.hex(digit.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def record_id(system: Column, source_id: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    return uuid5(F.concat(system, F.lit(":"), source_id), namespace)

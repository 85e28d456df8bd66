"""Filling fixed-capacity containers with texts, by sum-of-squares online packing.

Sizes are tokens of a public tokenizer. A container's fill is its level; N[h] counts the open
containers of level h. Each text goes to the level (or a new container) that makes the sum of the
squared counts smallest, which keeps levels from piling up where no text fits; ties go to the
fullest container. Only a text larger than the capacity is split: into full containers and a rest.

Scale: the texts are tokenized in a narrow map; only (doc_id, tokens) is shuffled. They are dealt by
hash to shards of about SHARD tokens, each packed by one task for all capacities, so the work per
task is bounded whatever the table's size. What stays open in a shard is packed once more as whole
containers over SHARDS_MERGED shards.

Defined results: null and empty texts hold no tokens and are not assigned; rows without an id and
capacities that are null or not positive are ignored; repeated doc_ids are packed for each row,
numbered on as parts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import settle, spread

#: Tokens of one shard, and shards whose open containers are packed together.
SHARD = 4_000_000
SHARDS_MERGED = 64
#: The public tokenizer: a file of ranks, and the pattern that cuts text into pieces.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str = RANKS, pattern: str = PATTERN) -> Callable[[str], int]:
    """Counts the tokens of a text. The file must lie at the same path on every executor."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def token_counts(documents: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every text that has any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = tokenizer(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "tokens": [size(t) for t in pdf.text]})

    rows = documents.where("doc_id is not null").where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInPandas(count, "doc_id bigint, tokens bigint")


class Containers:
    """Sum-of-squares packing of whole items into containers of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """The container an item of 0 < size <= capacity goes to."""
        c, n = self.capacity, self.count
        best, gain = 0, 1 if size == c else 2 * int(n[size]) + 1
        if size == c:
            gain = 0  # opens and closes at once
        if c > size:
            levels = np.flatnonzero(n[1 : c - size + 1]) + 1
            if len(levels):
                to = levels + size
                cost = np.where(to == c, 1 - 2 * n[levels], 2 + 2 * (np.where(to < c, n[to], 0) - n[levels]))
                k = len(cost) - 1 - int(np.argmin(cost[::-1]))  # ties: the fullest
                if cost[k] <= gain:
                    best = int(levels[k])
        if best:
            where = self.open[best].pop()
            n[best] -= 1
        else:
            where = len(self.fill)
            self.fill.append(0)
        self.fill[where] = best + size
        if best + size < c:
            self.open[best + size].append(where)
            n[best + size] += 1
        return where

    def full(self) -> int:
        """A container that one piece of a split item fills."""
        self.fill.append(self.capacity)
        return len(self.fill) - 1


_ROWS = "capacity_name string, shard bigint, container bigint, doc_id bigint, part_no bigint, tokens bigint"


def pack(items: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Rows (container, doc_id, part_no, tokens) and the containers' fills, in order of the items."""
    held, rows = Containers(capacity), []
    parts: dict[int, int] = {}
    for doc, size in items:
        while size > 0:
            piece = min(size, capacity)
            parts[doc] = parts.get(doc, 0) + 1
            rows.append((held.full() if size > capacity else held.place(piece), doc, parts[doc], piece))
            size -= piece
    return rows, held.fill


def _pack_shard(capacities: dict[str, int]):
    """Packs the shard that a task holds, whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [pdf for pdf in batches if len(pdf)]
        if frames:
            shard = int(frames[0].shard.iloc[0])
            items = sorted(i for pdf in frames for i in zip(pdf.doc_id.tolist(), pdf.tokens.tolist()))
            for name, capacity in capacities.items():
                out = [(name, shard, *r) for r in pack(items, capacity)[0]]
                yield pd.DataFrame(out, columns=["capacity_name", "shard", "container", "doc_id", "part_no", "tokens"])

    return run


def _merge_open(capacities: dict[str, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf.capacity_name.iloc[0]
        held, first, out = Containers(capacities[name]), {}, []
        for shard, container, fill in sorted(zip(pdf.shard.tolist(), pdf.container.tolist(), pdf.fill.tolist()), key=lambda x: (-x[2], x[0], x[1])):
            where = held.place(fill)
            first.setdefault(where, (shard, container))
            out.append((name, shard, container, *first[where]))
        return pd.DataFrame(out, columns=["capacity_name", "shard", "container", "to_shard", "to_container"])

    return run


def packed(documents: DataFrame, capacities: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(capacity_name, container_id, doc_id, part_no, tokens): where each text, or part of a text
    beyond the capacity, lies."""
    # a handful of rows by its nature; each row costs one packing of everything
    sizes = {r.capacity_name: int(r.capacity_tokens) for r in capacities.where("capacity_tokens > 0 and capacity_name is not null").select("capacity_name", "capacity_tokens").distinct().orderBy("capacity_name", F.desc("capacity_tokens")).toLocalIterator()}
    counts = settle(token_counts(documents, path, pattern))
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    # one task for each shard: rows of a few bytes would otherwise be put together again
    rows = settle(dealt.repartitionById(shards, F.col("shard").cast("int")).mapInPandas(_pack_shard(sizes), _ROWS))
    keys = ["capacity_name", "shard", "container"]
    limit = F.create_map(*[F.lit(x) for p in (sizes or {"": 0}).items() for x in p])[F.col("capacity_name")]
    loose = rows.groupBy(*keys).agg(F.sum("tokens").alias("fill")).where(F.col("fill") < limit).withColumn("g", F.floor(F.col("shard") / SHARDS_MERGED))
    moved = loose.groupBy("capacity_name", "g").applyInPandas(_merge_open(sizes), "capacity_name string, shard bigint, container bigint, to_shard bigint, to_container bigint")
    at = rows.join(moved, keys, "left")
    where = F.shiftleft(F.coalesce("to_shard", "shard"), 32) + F.coalesce("to_container", "container")
    return at.select("capacity_name", where.alias("container_id"), "doc_id", "part_no", "tokens")


def fills(assignment: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and unused tokens."""
    each = assignment.groupBy("capacity_name", "container_id").agg(F.sum("tokens").alias("fill"))
    return each.join(F.broadcast(capacities.groupBy("capacity_name").agg(F.min("capacity_tokens").alias("capacity_tokens")).limit(10_000)), "capacity_name").groupBy("capacity_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").cast("bigint").alias("tokens"), F.sum(F.col("capacity_tokens") - F.col("fill")).cast("bigint").alias("unused"))

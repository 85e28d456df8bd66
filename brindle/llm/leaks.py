"""Evaluation texts leaking into training text, by latent semantic retrieval.

Passages (windows of WINDOW words, every half window, over whole texts) are TF-IDF vectors over the
items' vocabulary. A randomised SVD of the passages of all documents, stacked with the items' own at
equal energy, is computed in one distributed pass: each partition sums its part of AᵀA·Ω, the parts
are added by term, and the Nyström formula turns the sum into an orthonormal basis. Passages whose
cosine with an item in that basis reaches COSINE are candidates; a longest common subsequence of
words against the item then counts the words that follow the item's order in dense runs, and the
answer check asks that the item's own rare words, not just its turns of phrase, are among them.

Scale: the documents are tokenised once, into codes of the items' words (-1 for all other words), a
table that two light passes read for each block of items. The sums of a pass are made by a bounded number
of tasks for each core, so what is shuffled or broadcast has the size of the items' vocabulary times
the rank, however many files the documents have. Items are a stated query set: they are worked off in
blocks of ITEM_BLOCK, so any number of them fits the driver.

Defined results: null and empty texts and items leak nothing; items shorter than LEAST words are no
case; repeated item ids are taken as one item with all its texts; repeated documents each count;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.aligning import fold, lcs_pairs
from brindle.session import settle, spread

#: Words of a case by its statement.
LEAST = 20
WINDOW = 48
COSINE = 0.3
#: Rank of the basis beyond the number of items of a block, and its largest value.
OVERSAMPLE, MOST_RANK = 64, 768
#: Items are compared in blocks of so many, so that the basis has room for each of them.
ITEM_BLOCK = MOST_RANK - OVERSAMPLE
SEED = 7
#: A word in more than these shares of items and documents carries no weight.
COMMON_ITEMS, COMMON_DOCS = 0.25, 0.02
#: Tasks for each core that add up a sketch.
SUMS = 2
#: Of the item's words spanned by dense runs, this share must be matched.
DENSITY = 0.6

_WORDS = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = _BROKEN.sub("", _INVISIBLE.sub("", text))
    return _WORDS.findall(text.lower() if text.isascii() else fold(text))


class Items:
    """A block of items: their words as codes, vocabulary with weights, and unit vectors."""

    def __init__(self, texts: dict[int, list[int]], docs: int, frequency: np.ndarray):
        self.words = {i: w for i, w in texts.items() if len(w) >= LEAST}
        self.ids = sorted(self.words)
        of_items = Counter(t for w in self.words.values() for t in set(w))
        n = max(1, len(self.words))
        #: Place of each code in the block's vocabulary, -1 for none; the last entry stands for unknown words.
        self.index = np.full(len(frequency) + 1, -1, dtype=np.int64)
        weights = []
        for t in sorted(of_items):
            if of_items[t] > COMMON_ITEMS * n and frequency[t] > COMMON_DOCS * docs:
                continue
            self.index[t] = len(weights)
            weights.append(max(math.log((1 + docs) / (1 + frequency[t])), math.log((1 + n) / of_items[t])))
        self.weights = np.array(weights, dtype=np.float32)
        # an item's answer words: those that hardly any other item has
        self.rare = {i: {t for t in set(w) if of_items[t] <= max(1, n // 100)} for i, w in self.words.items()}

    def vector(self, codes: np.ndarray | list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sparse unit vector of a passage: places and values; empty where no word is known."""
        at = self.index[codes]
        at, counts = np.unique(at[at >= 0], return_counts=True)
        values = ((1 + np.log(counts)) * self.weights[at]).astype(np.float32)
        norm = float(np.linalg.norm(values))
        return (at, values / norm) if norm else (at[:0], values[:0])


def passages(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = WINDOW // 2
    for start in range(0, max(1, len(words) - step), step):
        yield start, words[start : start + WINDOW]


def covered(doc: list[int], item: list[int], rare: set[int]) -> tuple[int, int, int, int]:
    """Of the dense runs of doc along item: matched words, item words spanned, rare words matched
    and rare words spanned."""
    runs: list[list[tuple[int, int]]] = []
    for pair in lcs_pairs(item, doc):
        if runs and pair[0] - runs[-1][-1][0] <= 5 and pair[1] - runs[-1][-1][1] <= 8:
            runs[-1].append(pair)
        else:
            runs.append([pair])
    matched = spanned = hit = due = 0
    for run in runs:
        a, b = run[0][0], run[-1][0]
        if len(run) >= 4 and len(run) >= DENSITY * (b - a + 1) and any(item[x] in rare for x, _ in run) >= bool(rare):
            matched += len(run)
            spanned += b - a + 1
            hit += sum(item[x] in rare for x, _ in run)
            due += sum(w in rare for w in item[a : b + 1])
    return matched, spanned, hit, due


def is_leak(matched: int, spanned: int, hit: int, due: int, has_rare: bool) -> bool:
    """Twenty words of the item, a few of which may be changed or left out at the passage's ends too."""
    if spanned < LEAST - 1 or matched < DENSITY * LEAST:
        return False
    return hit >= 2 and hit >= 0.5 * due if has_rare else matched >= 0.8 * spanned


def _coded(documents: DataFrame, codes: dict[str, int]) -> DataFrame:
    """(doc_id, codes): each document's words as codes of the items' words."""
    held = documents.sparkSession.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = held.value.get
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "codes": [np.fromiter((code(w, -1) for w in words_of(t)), dtype=np.int32) for t in pdf.text]})

    return settle(documents.mapInPandas(encode, "doc_id bigint, codes array<int>"))


def _frequencies(coded: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of those holding each item word."""
    found = np.zeros(size, dtype=np.int64)
    for r in coded.select(F.explode(F.array_distinct("codes")).alias("t")).where("t >= 0").groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        found[r.t] = r.n
    return coded.count(), found


def _basis(coded: DataFrame, items: Items) -> np.ndarray:
    """Orthonormal basis (vocabulary by rank) of the leading right singular space."""
    d = len(items.weights)
    rank = max(1, min(d, len(items.ids) + OVERSAMPLE, MOST_RANK))
    sc = coded.sparkSession.sparkContext
    omega = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, rank)))[0].astype(np.float32)
    held = sc.broadcast((items, omega))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        its, om = held.value
        total, energy = np.zeros((len(om), om.shape[1]), dtype=np.float32), 0.0
        for pdf in batches:
            for codes in pdf.codes:
                for _, some in passages(codes):
                    at, values = its.vector(some)
                    if len(at):
                        total[at] += values[:, None] * (values @ om[at])
                        energy += 1.0
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pd.DataFrame({"i": [-1, *used.tolist()], "v": [np.array([energy], dtype=np.float32), *total[used]]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, v in zip(pdf.i, pdf.v):
                sums[i] = sums[i] + np.asarray(v) if i in sums else np.asarray(v, dtype=np.float64)
        yield pd.DataFrame({"i": list(sums), "v": list(sums.values())})

    parts = coded.select("codes").coalesce(SUMS * sc.defaultParallelism).mapInPandas(sketch, "i int, v array<float>").repartition("i").mapInPandas(add, "i int, v array<double>").collect()
    y, energy = np.zeros((d, rank)), 1.0
    for r in parts:
        if r.i < 0:
            energy = max(1.0, r.v[0])
        else:
            y[r.i] = r.v
    own = np.zeros((d, rank))
    for i in items.ids:
        at, values = items.vector(items.words[i])
        own[at] += values[:, None] * (values @ omega[at])
    y += own * energy / max(1, len(items.ids))
    core = omega.T @ y
    # Nyström: AᵀA ≈ Y (ΩᵀY)⁻¹ Yᵀ; its range is spanned by Y times the root of the inverse
    w, u = np.linalg.eigh((core + core.T) / 2)
    good = w > 1e-7 * max(w.max(), 1e-12)
    left, s, _ = np.linalg.svd(y @ (u[:, good] / np.sqrt(w[good])), full_matrices=False)
    return np.ascontiguousarray(left[:, s > 1e-6 * s.max()], dtype=np.float32)


def _search(coded: DataFrame, items: Items, basis: np.ndarray) -> DataFrame:
    index = np.zeros((len(items.ids), basis.shape[1]), dtype=np.float32)
    for k, i in enumerate(items.ids):
        at, values = items.vector(items.words[i])
        index[k] = values @ basis[at]
    index /= np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    held = coded.sparkSession.sparkContext.broadcast((items, basis, index))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        its, v, idx = held.value
        for pdf in batches:
            out = []
            for doc, words in zip(pdf.doc_id, pdf.codes):
                starts, latent = [], []
                for start, some in passages(words):
                    at, values = its.vector(some)
                    if len(at):
                        starts.append(start)
                        latent.append(values @ v[at])
                if not starts:
                    continue
                # the cosine's norm is the passage's own: what the basis can't hold counts against it
                close = np.asarray(latent) @ idx.T
                for k in np.flatnonzero(close.max(0) >= COSINE):
                    i = its.ids[k]
                    spans: list[list[int]] = []
                    for p in np.flatnonzero(close[:, k] >= COSINE):
                        a, b = max(0, starts[p] - WINDOW), starts[p] + 2 * WINDOW
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        else:
                            spans.append([a, b])
                    got = np.zeros(4, dtype=int)
                    for a, b in spans:
                        got += covered(words[a:b].tolist(), its.words[i], its.rare[i])
                    if is_leak(*got.tolist(), bool(its.rare[i])):
                        out.append((doc, i, float(close[:, k].max()), int(got[0])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "words"])

    return coded.mapInPandas(scan, "doc_id bigint, item_id bigint, cosine double, words bigint")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, words) of every document that holds a passage of an item."""
    docs = spread(documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    wanted = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").orderBy("item_id", "text")
    codes: dict[str, int] = {}
    for r in wanted.toLocalIterator():
        for w in words_of(r.text):
            codes.setdefault(w, len(codes))
    none = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, words bigint")
    if not codes:
        return none
    coded = _coded(docs, codes)
    n, frequency = _frequencies(coded, len(codes))
    texts: dict[int, list[int]] = {}
    out = none

    def block() -> DataFrame:
        items = Items(texts, n, frequency)
        return _search(coded, items, _basis(coded, items)) if items.ids and len(items.weights) and n else none

    for r in wanted.toLocalIterator():
        if r.item_id not in texts and len(texts) >= ITEM_BLOCK:
            out = out.unionByName(block())
            texts = {}
        texts[r.item_id] = texts.get(r.item_id, []) + [codes[w] for w in words_of(r.text)]
    return out.unionByName(block())

import random

import pytest

from brindle.llm import packing

DOCS = "doc_id bigint, text string, tokens bigint, shard bigint, container bigint"
CAPS = "capacity_name string, capacity_tokens bigint, fill bigint"


def brute_place(fills, size, capacity):
    """The sum-of-squares rule by trying every level."""
    counts = {h: fills.count(h) for h in set(fills) if h < capacity}
    options = {}
    for h in [0, *counts]:
        if h + size <= capacity:
            after = dict(counts)
            if h:
                after[h] -= 1
            if h + size < capacity:
                after[h + size] = after.get(h + size, 0) + 1
            options[h] = sum(v * v for v in after.values())
    least = min(options.values())
    return max(h for h, v in options.items() if v == least)


def test_places_like_the_rule():
    random.seed(3)
    held = packing.Containers(20)
    for _ in range(300):
        size, before = random.randint(1, 20), list(held.fill)
        where = held.place(size)
        level = before[where] if where < len(before) else 0
        assert level == brute_place(before, size, 20) and held.fill[where] == level + size


def test_waste_is_small_and_nothing_is_split_that_fits():
    random.seed(4)
    items = [(i, random.randint(1, 300)) for i in range(3000)] + [(9999, 1300)]
    rows, fills = packing.pack(items, 512)
    assert max(fills) <= 512 and sum(r[3] for r in rows) == sum(s for _, s in items)
    parts = [r for r in rows if r[1] == 9999]
    assert [r[3] for r in parts] == [512, 512, 276] and len({r[1] for r in rows if r[2] > 1}) == 1
    assert 1 - sum(fills) / (512 * len(fills)) < 0.02


def test_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 200)
    rows = [(i, "word " * (i % 40 + 1), 1, 1, 1) for i in range(200)] + [(500, None, 1, 1, 1), (501, "", 1, 1, 1), (None, "x", 1, 1, 1), (502, "long " * 3000, 1, 1, 1), (7, "twice", 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    caps = spark.createDataFrame([("a", 64, 1), ("b", 100, 1), (None, 5, 1), ("c", None, 1), ("d", 0, 1)], CAPS)
    got = packing.packed(docs, caps).cache()
    size = {r.doc_id: 0 for r in got.collect()}
    for r in packing.token_counts(docs).collect():
        size[r.doc_id] += r.tokens
    for name, capacity in (("a", 64), ("b", 100)):
        mine = got.where(got.capacity_name == name)
        assert {r.doc_id: r.t for r in mine.groupBy("doc_id").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()} == size
        assert mine.groupBy("container_id").agg({"tokens": "sum"}).where(f"`sum(tokens)` > {capacity}").count() == 0
        assert mine.select("doc_id", "part_no").distinct().count() == mine.count()
    fill = {r.capacity_name: r for r in packing.fills(got, caps).collect()}
    assert set(fill) == {"a", "b"} and fill["b"].unused < 0.15 * fill["b"].tokens
    assert packing.packed(docs.limit(0), caps).count() == 0 and packing.packed(docs, caps.limit(0)).count() == 0


def test_counts_are_those_of_the_tokenizer_file():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    count = packing.tokenizer()
    for s in ("The bond — void. § 12", "Zoë's 'l’été' 1998\n\n  x", "<|endoftext|> привет"):
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids)

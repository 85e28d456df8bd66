import random

from brindle.llm import leaks

DOCS = "doc_id bigint, text string, item_id bigint, cosine double, words string"
ITEMS = "item_id bigint, text string, k string"


def corpus():
    random.seed(6)
    common = "the court held that a bond of record was void and counsel for each side then asked if any lease had closed before trial".split()
    items = [(i, " ".join(w for j in range(60) for w in (random.choice(common), f"name{i}x{j % 5}")[: 1 + (j % 2)])) for i in range(12)]
    docs = [(100 + k, " ".join(random.choice(common) for _ in range(300)), 1, 1.0, "w") for k in range(60)]
    return items, docs


def test_finds_passages_in_any_dress_and_no_short_quotes(spark):
    items, docs = corpus()
    words = {i: t.split() for i, t in items}
    pad = docs[0][1]
    changed = list(words[3][5:45])
    for k in (4, 13, 22, 31):
        changed[k] = "other"
    cases = {1: pad + " " + " ".join(words[0][:30]).upper() + " " + pad, 2: pad + "\n" + "\n".join(words[1][10:40]), 3: pad + " " + " ".join(changed) + " " + pad, 4: pad + " " + " ".join(words[4][:7]) + " " + pad, 5: None, 6: "", 7: " ".join(words[5]) + " " + " ".join(words[6]), 8: pad + " " + " ".join(words[2][:15]) + " " + " ".join(pad.split()[:6]) + " " + " ".join(words[2][15:32])}
    rows = [*docs, *((i, t, 1, 1.0, "w") for i, t in cases.items()), (9, pad * 200 + " " + " ".join(words[8][:40]), 1, 1.0, "w"), (9, pad, 1, 1.0, "w")]
    bench = [(i, t, "k") for i, t in items] + [(50, None, "k"), (51, "too short to leak", "k"), (None, items[0][1], "k")]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, ITEMS)).collect()}
    assert got == {(1, 0), (2, 1), (3, 3), (7, 5), (7, 6), (8, 2), (9, 8)}


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    items, docs = corpus()
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 5)
    d = spark.createDataFrame([*docs, (1, items[9][1], 1, 1.0, "w"), (2, items[0][1], 1, 1.0, "w")], DOCS)
    b = spark.createDataFrame([(i, t, "k") for i, t in items], ITEMS)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, b).collect()} == {(1, 9), (2, 0)}
    assert leaks.leaks(d.limit(0), b).count() == 0 and leaks.leaks(d, b.limit(0)).count() == 0


def test_the_basis_has_room_for_every_item_of_a_block():
    assert leaks.ITEM_BLOCK + leaks.OVERSAMPLE <= leaks.MOST_RANK

import random

import pytest

from brindle.llm import encodings as enc

SCHEMA = "doc_id bigint, text string, lang string, chains string, lossy boolean"


def clean():
    random.seed(8)
    fr = ["La société José Martin soutient que la créance était déjà éteinte à cette date.", "L’arrêt attaqué énonce que le délai fut prorogé après la notification.", "Les pièces versées aux débats révèlent une irrégularité très sérieuse."]
    ru = ["Свидетель показал, что договор был подписан позднее указанной даты.", "Истец подал жалобу в суд города в установленный срок."]
    en = ["The clerk’s note reads: “¶ 12, levy construed.” Under § 40 a bond must be served.", "It’s settled — since Núñez v. Björn — that the board at Côte-Brelin governs."]
    rows = []
    for lang, said in (("fr", fr), ("ru", ru), ("en", en)):
        for _ in range(120):
            rows.append((lang, " ".join(random.choices(said, k=4))))
    return rows


def garble(text, written, seen):
    return text.encode(written).decode(seen, "replace") if seen != "cp1252" else "".join(enc.upper_half("cp1252")[b - 128] if b > 127 else chr(b) for b in text.encode(written))


def test_finds_restores_and_leaves_alone(spark):
    base = clean()
    rows = [(i, t, lang, "c", True) for i, (lang, t) in enumerate(base)]
    fr, ru, en = (next(t for lang, t in base if lang == x) for x in ("fr", "ru", "en"))
    bad = {1001: (garble(fr, "utf-8", "cp1252"), fr), 1002: (garble(garble(fr, "utf-8", "cp1252"), "utf-8", "cp1252"), fr), 1003: (garble(ru, "cp1251", "cp1252"), ru), 1004: (garble(en, "utf-8", "mac_roman"), en), 1005: (garble(fr, "utf-8", "cp437"), fr), 1006: (en + "\n" + garble(fr, "utf-8", "cp1252"), en + "\n" + fr)}
    rows += [(i, g, None, "c", True) for i, (g, _) in bad.items()] + [(1007, "lost � sign", "en", "c", True), (2001, None, "en", "c", True), (2002, "", None, "c", True), (2003, "plain ascii", "en", "c", True), (2004, "L’ÂGE requis à SÃO", "fr", "c", True), (2005, "x" * 300_000 + " é", "fr", "c", True), (1001, bad[1001][0], None, "c", True)]
    got = enc.restored(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {*bad, 1007}
    assert {r.doc_id: r.text for r in got if r.doc_id in bad} == {i: t for i, (_, t) in bad.items()}
    assert [r.lossy for r in got if r.doc_id == 1007] == [True]


def test_empty_and_unlabelled(spark):
    assert enc.restored(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.doc_id for r in enc.restored(spark.createDataFrame([(1, "cafÃ©", None, "c", True), (2, "café", None, "c", True)], SCHEMA)).collect()] == [1]


@pytest.mark.parametrize("encoding", enc.UTF8_SEEN_AS)
def test_valid_sequences_come_back(encoding):
    text = "é — Łódź § привет"
    seen = "".join(enc.upper_half(encoding)[b - 128] if b > 127 else chr(b) for b in text.encode())
    assert enc.as_utf8(seen, encoding) == text


def test_models_are_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(enc, "SAMPLE_DOCS", 5, raising=False)
    monkeypatch.setattr(enc, "PART_BYTES", 20_000, raising=False)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    said = "la société soutient que"
    rows = [(i, f"{said} {word()} {word()} {word()}" + (" œuvre" if i % 100 == 0 else " Ñàéò" if i == 7 else ""), "fr", "c", True) for i in range(1000)]
    data, letters = enc.train(spark.createDataFrame(rows, SCHEMA))["fr"]
    assert letters == "éœ" and said.encode() in data and len(data) <= enc.DICTIONARY_BYTES
    assert enc.train(spark.createDataFrame(rows, SCHEMA).repartition(7)) == {"fr": (data, letters)}

from brindle.llm import turns

SCHEMA = "audio_id bigint, transcript string, timestamp_index array<struct<start_seconds double, end_seconds double, speaker string, text string>>, participants array<string>, ingested_at timestamp_ntz, turns string, speaker string"
PEOPLE = ["Ann Lee", "Bo Stone"]


def found(spark, rows):
    return [tuple(r) for r in turns.speaker_turns(spark.createDataFrame(rows, SCHEMA)).select("audio_id", "turn_no", "speaker").orderBy("audio_id", "turn_no").collect()]


def seg(start, end, who, text):
    return {"start_seconds": start, "end_seconds": end, "speaker": who, "text": text}


def test_order_labels_fillers_and_repeats(spark):
    index = [seg(5.0, 6.0, "MR. STONE", "second words here"), seg(1.0, 2.0, "Justice Lee", "first uh, words"), seg(1.0, 2.0, None, "first uh, words"), seg(3.0, 4.0, "Stone, B.", "Um --"), seg(4.0, None, None, "and more"), seg(7.0, 8.0, "Stonne", "third"), seg(9.0, 9.5, None, "[coughs]"), seg(10.0, 11.0, "A. Lee", "last")]
    got = turns.turns_of(None, index, PEOPLE)
    assert [(t[1], t[3]) for t in got] == [("Ann Lee", "first words"), ("Bo Stone", "and more second words here third"), ("Ann Lee", "last")]


def test_layouts_agree():
    want = ["Ann Lee", "Bo Stone"]
    for text in ("JUSTICE LEE: one two\nMs. Stone: three", "[00:00:01] Lee: one two\n[00:00:05] Stone: three", "Lee (0:01): one two\nB. Stone (0:05): three", ">> Ann Lee, Esq.: one\ntwo\n>> Stone: three", "00:00:01,000 --> 00:00:02,000\nLee: one two\n\n00:00:03,000 --> 00:00:04,000\nStone: three", "Lee - one two\nStone - three", "[00:00:05] Stone: three\n[00:00:01] Lee: one two"):
        assert [t[1] for t in turns.turns_of(text, None, PEOPLE)] == want, text


def test_rolling_captions_keep_only_new_words():
    index = [seg(0.0, 1.0, "Lee", "we hold that the bond"), seg(1.0, 2.0, "Lee", "that the bond was void"), seg(2.0, 3.0, "Lee", "was void")]
    assert turns.turns_of(None, index, PEOPLE)[0][3] == "we hold that the bond was void"


def test_edges(spark):
    rows = [
        (1, None, None, PEOPLE, None, "x", "y"), (2, "", [], PEOPLE, None, "x", "y"), (3, "Uh.\n[laughter]", None, PEOPLE, None, "x", "y"), (4, "no label here", None, None, None, "x", "y"), (None, "Lee: a b", None, PEOPLE, None, "x", "y"),
        (5, "Lee: a b", None, PEOPLE, None, "x", "y"), (5, "Lee: a b", None, PEOPLE, None, "x", "y"), (6, "Lee: " + "word " * 50_000, None, PEOPLE, None, "x", "y"), (7, None, [None, seg(None, None, None, None), seg(None, None, "Lee", "ok then")], PEOPLE, None, "x", "y"),
    ]
    assert found(spark, rows) == [(4, 1, None), (5, 1, "Ann Lee"), (6, 1, "Ann Lee"), (7, 1, "Ann Lee")]
    assert found(spark, []) == []

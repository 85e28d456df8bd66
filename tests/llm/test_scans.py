from brindle.llm import scans

SCHEMA = "image_id bigint, document_id bigint, page_number int, ocr_text string, keys string, n bigint, text string"
BODY = "The witness said that the tenancy was void because the court had not heard the ledger before the hearing closed in the town."


def pages():
    out = []
    for d in range(40):
        for p in range(3):
            body = "\n".join([BODY, "Counsel argued that the pre- or post-hearing papers were timely and that the surety had been heard.", f"Page words {d} and the ledger of the witness"])
            out.append((d * 10 + p, d, p + 1, f"DOE v. ROE {p + 1}\n\n{body}\n\n- {p + 1} -", "x", 1, "y"))
    return out


def test_kinds_of_noise(spark):
    noisy = "DOE v. ROE 4\n\nThc witness said that fhe ledger was void because the ten-\nancy had not been heard before the pre-\nor post-hearing papers.\nThe court had not heard tlie ledger.\nThe court had not heard the ledger.\n\n- 4 -"
    df = spark.createDataFrame([*pages(), (999, 0, 4, noisy, "x", 1, "y"), (998, 1, 9, None, "x", 1, "y"), (997, None, None, "", "x", 1, "y"), (996, None, None, "void", "x", 1, "y")], SCHEMA)
    rows = [tuple(r)[1:] for r in scans.noise(df).where("image_id = 999").orderBy("line_no", "noise").collect()]
    assert rows == [(1, "furniture"), (3, "hyphen"), (3, "misread"), (6, "misread"), (9, "furniture")]
    assert scans.noise(df).where("image_id in (998, 997, 996)").count() == 0
    text = scans.clean_pages(df).where("image_id = 999").collect()[0].text
    assert text.startswith("The witness said that the ledger was void because the tenancy had") and "the pre- or post-hearing" in text and "- 4 -" not in text


def test_empty_table(spark):
    assert scans.noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_rules():
    assert scans.hyphen_end("the ten-") == "ten" and scans.hyphen_end("the ten¬ ") == "ten" and scans.hyphen_end("it was --") is None and scans.hyphen_end("it was -") is None
    assert scans.furniture_of(["12", "", "A body line of words", "iv"], set(), set()) == {0, 3}
    assert scans.furniture_of(["I.", "text", "II. BACKGROUND"], {scans.edge_key("II. BACKGROUND")}, set()) == set()


def test_numbers_with_letters():
    c = scans.Corrector(scans.Model({}, 1))
    assert c.mixed("l987") == "1987" and c.mixed("2O05") == "2005" and c.mixed("3d") == "3d" and c.mixed("12th") == "12th" and c.mixed("fr0m") == "from" and c.mixed("1987") == "1987"


def test_rare_words_stay_however_large_the_corpus(spark):
    rare = [(9000 + i, 9000 + i, 1, "Counsel called Mr. Tarvescote then.", "x", 1, "y") for i in range(4)]
    seen = (9100, 9100, 1, "Counsel called Mr. Tarvcscote then.", "x", 1, "y")
    filler = [(20_000 + i, 20_000 + i, 1, "\n".join([BODY] * 400), "x", 1, "y") for i in range(350)]
    model = scans.train(scans._pages(spark.createDataFrame([*rare, seen, *filler], SCHEMA)))
    assert model.total > 3_000_000 and model.known("tarvescote") and model.clean("tarvescote") >= 3.0
    assert not model.known("tarvcscote") and ("tarvescote", model.chance["e", "c"]) in model.sources("tarvcscote")


def test_words_broken_over_a_page_end(spark):
    filler = pages() + [(5000 + i, 5000 + i, 1, "The tenancy was void.", "x", 1, "y") for i in range(20)]
    one = "The ledger of the witness had been heard.\nThe court said that the tcn-"
    two = "ancy was void.\nThe hearing closed. The court had not heard the ten-"
    three = "ancv papers.\nThe surety had been heard."
    doc = [(701, 70, 1, one, "x", 1, "y"), (702, 70, None, two, "x", 1, "y"), (703, 70, 12, three, "x", 1, "y"), (704, 70, 4, None, "x", 1, "y"), (705, 70, 5, "A line of words.", "x", 1, "y")]
    df = spark.createDataFrame([*filler, *doc], SCHEMA)
    got = {tuple(r) for r in scans.noise(df).where("image_id between 701 and 705").collect()}
    assert {(701, 2, "hyphen"), (701, 2, "misread"), (702, 2, "hyphen")} <= got and (702, 1, "misread") not in got
    whole = scans.clean_documents(df).where("document_id = 70").collect()
    assert len(whole) == 1 and whole[0].pages == 4 and whole[0].image_id == 701
    assert "The court said that the tenancy was void. The hearing closed. The court had not heard the ten" in whole[0].text.replace("\n\n", " ") and whole[0].text.endswith("A line of words.")


def test_page_order():
    page = lambda i, n, *words, ok=True: (i, n, ok, frozenset(words))
    # a missing and a wrong number move nothing; a second scan, one unreadable, goes with its page
    assert scans.in_order([page(1, None, 1, 2, 3, 4), page(2, 102, 5, 6, 7, 8), page(3, 3, 9, 10, 11, 12), page(4, 3, 9, 10, 11, 13), page(5, 4, ok=False), page(6, 4, 14, 15, 16, 17)]) == [[0], [1], [2, 3], [5, 4]]
    # images that arrived backwards go by number
    assert scans.in_order([page(1, 3, 1, 2, 3, 4), page(2, 2, 5, 6, 7, 8), page(3, 1, 9, 10, 11, 12)]) == [[2], [1], [0]]


def test_words_are_mended_where_they_stand():
    counts = {"l there": 5000, "l thare": 5000, "l sat": 5000, "l he": 5, "l ha": 5000, "w There": 900}

    class Fixed(scans.Corrector):
        def word(self, shown, decoded):
            return "ha" if shown == "he" else shown

    rows = scans.read_page("there he (he) sat", set(), set(), Fixed(scans.Model(counts, 20_000)))
    assert (0, "", "there ha (ha) sat") in rows

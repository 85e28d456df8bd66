import random

import pytest

from brindle.llm import markup

SCHEMA = "text_id bigint, document_id bigint, plain_text string, html string, language string, ingested_at timestamp_ntz, text string, at string"


def kinds(text):
    return [k for k, _ in markup.read(text)[2] if k != "p"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h2>A</h2><p>b<ul><li>c<li>d</ul><pre>&lt;h1&gt;</pre><p class=formula>x=1</p>", ["heading", "list_item", "list_item", "code", "formula"]),
        ("# A\n\ntext\n\n- b\n- c\n\n```\n# not a heading\n```\n\n$$\nx\n$$\n\nTitle\n-----\n", ["heading", "list_item", "list_item", "code", "formula", "heading"]),
        ("== A ==\n'''b'''\n# one\n# two\n<pre>\n== no ==\n</pre>\n:<math>x</math>\n", ["heading", "list_item", "list_item", "code", "formula"]),
        ("\\section*{A}\n\\begin{itemize}\n \\item b\n\\end{itemize}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\\[ x \\]\n", ["heading", "list_item", "code", "formula"]),
        ("&lt;h3&gt;A&lt;/h3&gt;&lt;p&gt;b&lt;/p&gt;", ["heading"]),
    ],
)
def test_families(text, want):
    assert kinds(text) == want and markup.read(text)[1]


@pytest.mark.parametrize("text", ["Apt. # 12 was vacant; unit #14 was not.", "* * *", "The sign read *** NO ENTRY ***, he said.", "list_of_items_v2", "5 < 7 and 9 > 8", "He wrote x = y", "Fees of $400 to $500", "see C:\\rulings\\section\\item [sic]", "Signed this __ day of ____.", "Doe & Daughters", "", "-- end --"])
def test_lookalikes_are_no_markup(text):
    assert markup.read(text)[1] is False


@pytest.mark.parametrize("text", ["ruled<br>again", "court&#8217;s", "it \\emph{id.} said", "'''affirmed''' it", "so </i>held", "**affirmed** it", "{\\it supra} it"])
def test_residue_is_markup_without_elements(text):
    family, marked, blocks = markup.read(text)
    assert marked and not [k for k, _ in blocks if k != "p"] and "<" not in blocks[0][1] and "\\" not in blocks[0][1] and "*" not in blocks[0][1]


def stm(a, b):
    """Simple tree matching by its recursive definition, over every ordered matching of the children."""
    if a[0] != b[0]:
        return 0
    best = lambda x, y: 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + stm(x[0], y[0]))
    return 1 + 2 * (bool(a[1]) and a[1] == b[1]) + best(a[2], b[2])


def test_matching_against_its_definition():
    rng = random.Random(2)
    grow = lambda d: [rng.choice("xy"), "", [grow(d - 1) for _ in range(rng.randint(0, 3))]] if d and rng.random() < 0.7 else [rng.choice(["p", "heading"]), rng.choice("ab"), []]
    for _ in range(60):
        a, b = ["page", "", [grow(2) for _ in range(3)]], ["page", "", [grow(2) for _ in range(3)]]
        pairs = markup.match(a, b)
        assert sum(1 + 2 * (bool(x[1]) and x[1] == y[1]) for x, y in pairs) == stm(a, b)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs}) and all(x[0] == y[0] for x, y in pairs)


def test_trees_keep_nesting():
    tree = markup.parse("<div><h2>A</h2><ul><li>one<ul><li>inner</ul><li>two</ul></div><table><tr><td>x<td>y</table>")[2]
    assert tree[2][0][0] == "div" and [c[0] for c in tree[2][0][2]] == ["heading", "ul"]
    items = tree[2][0][2][1][2]
    assert [c[0] for c in items] == ["li", "li"] and [c[0] for c in items[0][2]] == ["list_item", "ul"]
    assert markup.blocks_of(tree) == [("heading", "A"), ("list_item", "one"), ("list_item", "inner"), ("list_item", "two"), ("p", "x y")]
    assert len(markup.blocks_of(markup.parse("<div>" * 3000 + "deep" + "</div>" * 3000)[2])) == 1


def test_wrapper_keeps_what_varies(spark):
    page = lambda t, extra="": f"<div><ul><li>Home<li>Search</ul></div><div><h1>{t}</h1><p>body of {t}</p>{extra}</div><div><p>All rights reserved</p></div>"
    rows = [(i, 1, None, page(f"case {i}", f"<p>more {i}</p>" * (i % 3)), "en", None, "x", "y") for i in range(40)] + [(100, 1, None, page("case 7", "<p>more 7</p>"), "en", None, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.text_id: r for r in markup.cleaned(df).collect()}
    assert got[5].text == "# case 5\n\nbody of case 5\n\nmore 5\n\nmore 5"
    assert [(e.kind, e.content) for e in got[5].elements] == [("list_item", False), ("list_item", False), ("heading", True)]
    assert markup.shape([["page", "", []]]) is None


def test_table(spark):
    rows = [(1, 1, "flat", "<h1>T</h1><p>b", "en", None, "x", "y"), (1, 1, "flat", "<h1>T</h1><p>b", "en", None, "x", "y"), (2, 1, "plain words", None, "en", None, "x", "y"), (3, 1, "# H\n\nbody", "", "en", None, "x", "y"), (4, 1, None, None, None, None, None, None), (None, 1, "# H", None, None, None, None, None), (5, 1, "# H\n\n" + "word " * 100_000, None, None, None, None, None)]
    got = [tuple(r) for r in markup.found(spark.createDataFrame(rows, SCHEMA)).orderBy("text_id", "elem_no").collect()]
    assert got == [(1, 0, "markup"), (1, 1, "heading"), (3, 0, "markup"), (3, 1, "heading"), (5, 0, "markup"), (5, 1, "heading")]
    assert markup.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_elements_that_most_pages_repeat_are_still_elements(spark):
    rows = [(i, 1, f"# Same heading\n\n- same item\n- own item {i}\n\nbody {i}", None, "en", None, "x", "y") for i in range(10)] + [(50 + i, 1, f"== T ==\n'''copy''' of one page", None, "en", None, "x", "y") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.kind for r in markup.found(df).where("text_id = 3").orderBy("elem_no").collect()]
    assert got == ["markup", "heading", "list_item", "list_item"]
    assert [r.kind for r in markup.found(df).where("text_id = 51").orderBy("elem_no").collect()] == ["markup", "heading"]
    assert "Same heading" not in markup.cleaned(df).where("text_id = 3").collect()[0].text


def test_the_wrapper_has_what_most_of_all_pages_have(spark):
    # one page in ten is bare: the smallest of any 64 pages says nothing of the template
    full = lambda i: f"<div><ul><li>Home<li>Search</ul></div><div><h1>case {i}</h1><p>body of {i}</p></div><div><p>All rights reserved</p></div>"
    rows = [(i, 1, None, full(i) if i % 10 else f"<div><p>bare {i}</p></div>", "en", None, "x", "y") for i in range(200)]
    got = {r.text_id: r.text for r in markup.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (f"# case {i}\n\nbody of {i}" if i % 10 else f"bare {i}") for i in range(200))

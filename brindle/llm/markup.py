"""Markup residue in text documents: HTML, Markdown, wiki and LaTeX into clean structured text.

A text is read into an ordered tree by the reader of its family: containers (divisions, sections, lists,
tables, as they nest) over blocks (heading, list item, code, formula, paragraph). Pages of one family
and make-up are "one host": their wrapper is induced by simple tree matching, which pairs two trees
node by node, level by level, in order, so that most nodes match. Blocks are counted over all distinct
pages; the page that holds most of those that most pages hold, the smallest of such pages, is the
wrapper's shape; every distinct page of the host is then aligned to it,
and the counts of all pages tell the wrapper's nodes apart: those that say the same on most pages are
template, the others are slots. A page's blocks are read off its alignment: what fills slots, or
has no node in the wrapper, is content; what matches a template node is furniture of the host.
Elements (found) are a page's own blocks, content or furniture; the clean printing leaves furniture out.

Scale: a re-delivered text is dropped in the shuffle that deals texts out; each text is parsed once,
into a table that the alignments read. Collected and broadcast are only the wrappers: one tree for each
of the few hosts (families times known element names).

Defined results: html goes before plain_text where it is neither null nor empty; null and empty
texts hold no markup; rows of one text_id are one record, of which the latest (then the one with the
largest text in order) counts; a null id gives no rows; an empty table gives no rows; extra columns
are ignored; unclosed tags end where the next block begins; containers nested deeper than DEEPEST count
as part of the one above them.
"""

from __future__ import annotations

import html as entities
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import settle

#: The share of all pages a template node is the same on.
CONSTANT = 0.8
#: Hosts of fewer distinct pages have no wrapper.
FEWEST = 3
#: Levels of containers.
DEEPEST = 60

Block = tuple[str, str]  # kind, text
Tree = list  # [label, text, children]: a container has children and no text, a block is labelled by its kind

# Element names by role.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "div", "section", "article", "blockquote", "table", "tr", "ul", "ol", "dl", "body", "html", "header", "footer", "nav", "main", "hr", "br")
CELLS = ("td", "th")
UNSEEN = ("script", "style", "head", "template", "noscript")
KNOWN = {*HEADINGS, *BLOCKS, *UNSEEN, "li", "pre", "math", "mtext", "code", "b", "i", "em", "strong", "a", "span", "font", "sup", "sub", "u", "s", "small", "big", "center", "img", "td", "th", "title", "meta", "link", "tt", "cite", "q", "dt", "dd", "o:p", "ref", "syntaxhighlight", "source", "nowiki", "del", "ins", "abbr", "label", "strike", "kbd", "samp", "var", "mark", "wbr", "thead", "tbody", "caption", "figure"}
FORMULA_CLASSES = ("formula", "equation", "math", "display-math", "displaymath", "katex-display")

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:]*)(?:\s+[^<>]*|\s*/)?>|<!--|<!DOCTYPE", re.I)
_ESCAPED = re.compile(r"&lt;(?:p|div|h[1-6]|ul|ol|li|pre|html|body|br|b|i|em|span)\b[^<>]{0,80}&gt;", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", re.I)
_TEX = re.compile(r"\\(?:begin|end|(?:sub)*section|chapter|paragraph|emph|text[a-z]{2,6}|cite[a-z]*|footnote|ref|label|item|documentclass|usepackage|title|frac|sum|S)\b\s*[\[{*~]?|\{\\(?:it|bf|em|tt|sc|sl|rm)\b|\\\[|\\[%$&#_]")
_TEX_SURE = re.compile(r"\\(?:begin|end|(?:sub)*section\*?|chapter\*?|paragraph|emph|text(?:bf|it|tt|sc|rm|sf)|cite[a-z]*|footnote|documentclass|usepackage)\s*(?:\[[^\]]*\])?\{|\{\\(?:it|bf|em|tt|sc|sl)\b|^\s*\\item\b|\\\[\s|\\S~", re.M)
_WIKI = re.compile(r"^(={1,6})[^=\n]+\1\s*$|'''[^'\n]+'''|(?<!')''[^'\n]+''(?!')|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^__[A-Z]{3,}__|<ref\b|<syntaxhighlight|:<math>|^\{\|", re.M)
_WIKI_TITLE = re.compile(r"^(={1,6})[^=\n]*\w[^=\n]*\1\s*$|^__[A-Z]{3,}__\s*$", re.M)
_MD = re.compile(r"^#{1,6}\s+\S|^(?:```|~~~)|(?<![\w*])\*\*(?=\S)[^*\n]+(?<=\S)\*\*(?![\w*])|(?<!\w)__(?=\S)[^_\n]+(?<=\S)__(?!\w)|(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<!\w)_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?!\w)|!?\[[^\]\n]+\]\([^)\s]+\)|\[\^[^\]\s]+\]|`[^`\n]+`|~~[^~\n]+~~|^\$\$|^>\s+\S|^\[[^\]]+\]:\s", re.M)
_BULLET = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,3}[.)])\s+(?!\*\s*\*)\S")
_UNDERLINE = re.compile(r"(?:={3,}|-{3,})[ \t]*")
_RULE = re.compile(r"^\s*(?:\*\s*){3,}$|^\s*(?:-\s*){3,}$")


class _Reader(HTMLParser):
    """Blocks of HTML, however badly closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: Tree = ["page", "", []]
        self.path: list[Tree] = [self.root]
        self.kind, self.parts = "p", []
        self.unseen: list[str] = []
        self.inside: list[tuple[str, str]] = []  # open pre and formula elements: tag, kind

    def flush(self, kind: str = "p"):
        text = "".join(self.parts)
        text = text.strip("\n") if self.kind == "code" else re.sub(r"\s+", " ", text).strip()
        if text:
            self.path[-1][2].append([self.kind, text, []])
        self.kind, self.parts = kind, []

    def open(self, tag: str):
        """A container begins; a paragraph or item that was left open ends."""
        names = [n[0] for n in self.path]
        if names[-1] == "p" or (names[-1] == tag and tag in ("li", "tr", "td", "th")):
            self.path.pop()
        if len(self.path) <= DEEPEST:
            node: Tree = [tag, "", []]
            self.path[-1][2].append(node)
            self.path.append(node)

    def shut(self, tag: str):
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k][0] == tag:
                del self.path[k:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen.append(tag)
        if self.unseen:
            return
        if self.inside:
            if tag == self.inside[-1][0]:
                self.inside.append(self.inside[-1])
            elif tag == "br":
                self.parts.append("\n")
            return
        a = {k: (v or "").lower() for k, v in attrs}
        formula = (tag == "math" and a.get("display") == "block") or (tag in ("p", "div", "span") and any(c in FORMULA_CLASSES for c in a.get("class", "").split()))
        if tag in ("pre", "syntaxhighlight") or formula:
            kind = "formula" if formula else "code"
            self.flush(kind)
            self.inside.append((tag, kind))
        elif tag in HEADINGS:
            self.flush("heading")
        elif tag == "li":
            self.flush("list_item")
            self.open(tag)
        elif tag in CELLS:
            self.parts.append(" ")
        elif tag in BLOCKS and not (tag == "br" and self.kind != "p"):
            keep = self.kind if self.kind in ("list_item", "heading") and tag in ("p", "div", "br") and not "".join(self.parts).strip() else "p"
            self.flush(keep)
            if tag not in ("br", "hr"):
                self.open(tag)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
            return
        if self.inside:
            if tag == self.inside[-1][0]:
                self.inside.pop()
                if not self.inside:
                    self.flush()
            return
        if tag in HEADINGS or tag == "li" or (tag in BLOCKS and tag != "br"):
            self.flush()
            self.shut(tag)

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def read_html(text: str) -> Tree:
    reader = _Reader()
    reader.feed(text)
    reader.close()
    reader.flush()
    return reader.root


def blocks_of(tree: Tree) -> list[Block]:
    """A tree's blocks in reading order."""
    out, stack = [], [tree]
    while stack:
        label, text, children = stack.pop()
        if text:
            out.append((label, text))
        stack.extend(reversed(children))
    return out


def tree_of(blocks: list[Block]) -> Tree:
    """Blocks of a text without elements of its own: a heading begins a section, list items in a row
    are a list."""
    root: Tree = ["page", "", []]
    section = root
    for kind, text in blocks:
        if kind == "heading":
            section = ["section", "", []]
            root[2].append(section)
        into = section
        if kind == "list_item":
            if not section[2] or section[2][-1][0] != "list":
                section[2].append(["list", "", []])
            into = section[2][-1]
        into[2].append([kind, text or " ", []])  # an empty element is one too
    return root


def _plain_tags(text: str) -> str:
    text = re.sub(r"<(script|style|ref)\b[^>]*>.*?</\1\s*>|<ref\b[^>]*/>|<!--.*?-->", " ", text, flags=re.S | re.I)
    text = _TAG.sub(lambda m: m[0] if m[1] and m[1].lower() not in KNOWN else " " if m[1] and m[1].lower() in BLOCKS else "", text)
    return entities.unescape(text)


def _inline(text: str, family: str) -> str:
    if family == "tex":
        text = re.sub(r"\s*~?\\(?:cite[a-z]*|footnote|label|ref)\s*(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
        for _ in range(3):
            text = re.sub(r"\\(?:emph|text[a-z]{2,3}|underline|mbox)\{([^{}]*)\}|\{\\(?:it|bf|em|tt|sc|sl|rm)\s+([^{}]*)\}", lambda m: m[1] or m[2] or "", text)
        text = re.sub(r"\\S\s*~?\s*", "§ ", text).replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("~", " ")
        return re.sub(r"\\([%$&#_{}])", r"\1", text)
    text = re.sub(r"'''''|'''|''(?!')|__[A-Z]{3,}__", "", text)
    text = re.sub(r"\[\[(?:Category|File|Image):[^\]]*\]\]|\{\{[^{}]*\}\}|\[\^[^\]\s]+\]:?", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"!?\[([^\]\n]*)\]\([^)\s]*\)", r"\1", text)
    text = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*)(?<=[^\s*])\1(?![\w*])|(?<!\w)(_{1,2})(?=[^\s_])([^_\n]*)(?<=[^\s_])\3(?!\w)", lambda m: m[2] or m[4] or "", text)
    return re.sub(r"`([^`\n]+)`|~~([^~\n]+)~~", lambda m: m[1] or m[2], text)


# LaTeX environments by what they hold.
_TEX_MATH = "equation|align|gather|multline|eqnarray|displaymath|math"
_TEX_CODE = "verbatim|lstlisting|minted|Verbatim|alltt"
_PIECES = re.compile(
    rf"\\begin\{{(?P<tc>(?:{_TEX_CODE})\*?)\}}(?P<tcode>.*?)(?:\\end\{{(?P=tc)\}}|\Z)"
    rf"|\\begin\{{(?P<tm>(?:{_TEX_MATH})\*?)\}}(?P<tmath>.*?)\\end\{{(?P=tm)\}}"
    r"|\\\[(?P<bracket>.*?)\\\]"
    r"|^[ \t]*\$\$(?P<dollar>.+?)\$\$"
    r"|^[ \t]{0,3}(?P<fence>```+|~~~+)[^\n]*\n(?P<fenced>.*?)(?:^[ \t]{0,3}(?P=fence)[ \t]*$|\Z)"
    r"|<(?P<ct>pre|syntaxhighlight|source)\b[^>]*>(?P<tagged>.*?)(?:</(?P=ct)\s*>|\Z)"
    r"|^:+\s*<math\b[^>]*>(?P<wmath>.*?)</math>|<math\b[^>]*display=[\"']?block[^>]*>(?P<hmath>.*?)</math>",
    re.S | re.M | re.I,
)
_TEX_HEAD = re.compile(r"^\s*\\(?:(?:sub){0,2}section|chapter|part|paragraph|title)\*?\s*\{(.*)\}\s*$")
_WIKI_HEAD = re.compile(r"^(={1,6})\s*([^=\n].*?)\s*\1\s*$")
_MD_HEAD = re.compile(r"^ {0,3}#{1,6}\s+(.*?)\s*#*\s*$")


def _underlined(text: str) -> int:
    """Lines that stand alone above an underline."""
    lines = text.split("\n")
    return sum(1 for i in range(1, len(lines)) if lines[i][:1] in ("=", "-") and _UNDERLINE.fullmatch(lines[i]) and lines[i - 1].strip() and (i == 1 or not lines[i - 2].strip()) and not re.match(r"[-*+#>|=]|\d+[.)]\s", lines[i - 1]))


def family_of(text: str) -> str:
    """html, tex, wiki, md or plain, by the surest signs of each."""
    tags = len([m for m in _TAG.finditer(text) if m[1] and m[1].lower() in {*HEADINGS, *BLOCKS, "li", "pre", "b", "em", "i", "a", "span"} and m[1].lower() != "br"])
    tex, wiki, md = len(_TEX_SURE.findall(text)), len(_WIKI.findall(text)), len(_MD.findall(text)) + _underlined(text)
    if _WIKI_TITLE.search(text):  # then lines on # are a wiki's numbered list
        wiki, md = wiki + len(re.findall(r"^[*#:;]+ ?\S", text, re.M)), md - len(re.findall(r"^#{1,6}\s+\S", text, re.M))
    most = max(tags / 2, tex, wiki, md)
    if most == 0:
        return "plain"
    return "tex" if tex == most else "wiki" if wiki == most else "md" if md == most else "html"


def _lines(text: str, family: str) -> Iterator[Block]:
    lines, i, para = text.split("\n"), 0, []

    def done() -> Iterator[Block]:
        said = re.sub(r"\s+", " ", _inline(_plain_tags(" ".join(para)), family)).strip()
        para.clear()
        if said:
            yield "p", said

    while i < len(lines):
        line = lines[i]
        kind, said = "", ""
        if family == "tex":
            if m := _TEX_HEAD.match(line):
                kind, said = "heading", m[1]
            elif m := re.match(r"\s*\\item\b(?:\[[^\]]*\])?\s*(.*)", line):
                kind, said = "list_item", m[1]
            elif re.match(r"\s*\\(?:begin|end|documentclass|usepackage|maketitle|label|centering)\b", line):
                kind = "drop"
        elif family == "wiki":
            if m := _WIKI_HEAD.match(line):
                kind, said = "heading", m[2]
            elif (m := re.match(r"([*#]+)\s*(\S.*)", line)) and not _RULE.match(line):
                kind, said = "list_item", m[2]
        else:
            if m := _MD_HEAD.match(line):
                kind, said = "heading", m[1]
            elif i + 1 < len(lines) and line.strip() and not para and not _BULLET.match(line) and _UNDERLINE.fullmatch(lines[i + 1]):
                kind, said, i = "heading", line, i + 1
            elif _BULLET.match(line) and not _RULE.match(line):
                kind, said = "list_item", re.sub(r"^\s*(?:[-*+]|\d{1,3}[.)])\s+", "", line)
            elif line.startswith(">"):
                line = line.lstrip("> ")
        if kind:
            yield from done()
            if kind != "drop":
                yield kind, re.sub(r"\s+", " ", _inline(_plain_tags(said), family)).strip()
        elif line.strip():
            para.append(line)
        else:
            yield from done()
        i += 1
    yield from done()


def read_plain(text: str, family: str) -> list[Block]:
    """Blocks of Markdown, wiki or LaTeX text: code and formulas first, lines between them."""
    out: list[Block] = []
    at = 0
    for m in _PIECES.finditer(text):
        out += _lines(text[at : m.start()], family)
        g = m.groupdict()
        code = next((g[k] for k in ("tcode", "fenced", "tagged") if g[k] is not None), None)
        math = next((g[k] for k in ("tmath", "bracket", "dollar", "wmath", "hmath") if g[k] is not None), None)
        out.append(("code", code.strip("\n")) if code is not None else ("formula", re.sub(r"\s+", " ", _plain_tags(math or "")).strip()))
        at = m.end()
    return out + list(_lines(text[at:], family))


def _list_marked(text: str) -> bool:
    """Two list lines in a row are a list's markup, one may be a sentence's number."""
    marks = [bool(_BULLET.match(x)) and not _RULE.match(x) for x in text.split("\n")]
    return any(a and b for a, b in zip(marks, marks[1:]))


def read(text: str | None) -> tuple[str, bool, list[Block]]:
    """Family, whether the text holds any markup, and its blocks."""
    family, marked, tree = parse(text)
    return family, marked, blocks_of(tree)


def parse(text: str | None) -> tuple[str, bool, Tree]:
    """Family, whether the text holds any markup, and its tree."""
    if not text or not text.strip():
        return "plain", False, ["page", "", []]
    if _ESCAPED.search(text) and not any(m[1] and m[1].lower() in KNOWN for m in _TAG.finditer(text)):
        text = entities.unescape(text)  # a page that was escaped as a whole
    family = family_of(text)
    stray = any(m[0].startswith("<!") or m[1].lower() in KNOWN for m in _TAG.finditer(text)) or bool(_ENTITY.search(text))
    if family == "plain" and _list_marked(text):
        family = "md"
    if family == "plain" and re.search(r"\\(?:emph|textbf|textit)\{|\{\\it ", text):
        family = "tex"
    marked = family != "plain" or stray
    if family == "html":
        return family, marked, read_html(text)
    if family == "plain":
        paragraphs = [re.sub(r"\s+", " ", _plain_tags(p)).strip() if stray else p.strip() for p in re.split(r"\n\s*\n", text)]
        return family, marked, tree_of([("p", p) for p in paragraphs if p])
    return family, marked, tree_of([(k, t) for k, t in read_plain(text, family) if t or k != "p"])


# ---- wrapper induction ---------------------------------------------------------------------


def _likeness(a: Tree, b: Tree, known: dict) -> int:
    """Simple tree matching: 0 for nodes of different labels; else 1, 2 more for the same text, and the
    best ordered matching of their children."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in known:
        row = [0] * (len(b[2]) + 1)
        for x in a[2]:
            before, row = row, [0]
            for j, y in enumerate(b[2]):
                row.append(max(before[j + 1], row[j], before[j] + _likeness(x, y, known)))
        known[key] = 1 + 2 * (bool(a[1]) and a[1] == b[1]) + row[-1]
    return known[key]


def match(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """The matched nodes of two trees, roots first."""
    known: dict = {}
    pairs: list[tuple[Tree, Tree]] = []
    stack = [(a, b)] if _likeness(a, b, known) else []
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        n, m = len(x[2]), len(y[2])
        if not n or not m:
            continue
        score = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + _likeness(x[2][i], y[2][j], known))
        i, j = n, m
        while i and j:
            if score[i][j] == score[i - 1][j]:
                i -= 1
            elif score[i][j] == score[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                stack.append((x[2][i], y[2][j]))
    return pairs


def size_of(tree: Tree) -> int:
    return 1 + sum(map(size_of, tree[2]))


def signs(tree: Tree) -> list[int]:
    """Hashes of a tree's distinct blocks."""
    return sorted({int.from_bytes(hashlib.blake2b(f"{kind}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True) for kind, text in blocks_of(tree)})


def shape(trees: list[Tree]) -> Tree | None:
    """The tree that a host's pages are aligned to: the first of its best ones."""
    return trees[0] if len(trees) >= FEWEST else None


def numbered(tree: Tree) -> dict[int, int]:
    """The number of each node of a tree in reading order, by identity."""
    out, stack = {}, [tree]
    while stack:
        node = stack.pop()
        out[id(node)] = len(out)
        stack.extend(reversed(node[2]))
    return out


def agreed(wrapper: Tree, page: Tree) -> list[tuple[int, Tree]]:
    """(number of the wrapper's node, the page's node) where both say the same."""
    number = numbered(wrapper)
    return [(number[id(a)], b) for a, b in match(wrapper, page) if a[1] and a[1] == b[1]]


def roles(tree: Tree, wrapper: Tree | None, template: frozenset) -> list[tuple[str, str, bool]]:
    """(kind, text, whether it is content) of a page's blocks, read off its alignment."""
    gone = {id(node) for k, node in agreed(wrapper, tree) if k in template} if wrapper is not None and template else set()
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node[1]:
            out.append((node[0], node[1], id(node) not in gone))
        stack.extend(reversed(node[2]))
    return out


def host_of(tree: Tree, family: str) -> str:
    """Pages of one make-up: the family, with the page's outermost element for HTML."""
    first = next((c[0] for c in tree[2] if not c[1]), "") if family == "html" else ""
    return f"{family}:{first}"


PRINT = {"heading": "# {}", "list_item": "- {}", "code": "```\n{}\n```", "formula": "$$ {} $$", "p": "{}"}


_PARSED = "text_id bigint, h bigint, host string, family string, marked boolean, tree string, size bigint, signs array<bigint>"


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [parse(t) for t in pdf.text]
        yield pd.DataFrame({"text_id": pdf.text_id, "h": pdf.h, "host": [host_of(t, f) for f, _, t in done], "family": [f for f, _, _ in done], "marked": [m for _, m, _ in done], "tree": [json.dumps(t, ensure_ascii=False) for _, _, t in done], "size": [size_of(t) for _, _, t in done], "signs": [signs(t) for _, _, t in done]})


def _pages(assets: DataFrame) -> DataFrame:
    """Every text's tree, once. The shuffle that drops re-delivered texts also deals the work out."""
    text = F.when(F.length("html") > 0, F.col("html")).otherwise(F.col("plain_text"))
    late = F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
    rows = assets.where("text_id is not null").select(F.col("text_id").cast("bigint").alias("text_id"), text.alias("text"), late.alias("at")).where(F.length("text") > 0)
    dealt = rows.repartition(4 * assets.sparkSession.sparkContext.defaultParallelism, "text_id") if rows.rdd.getNumPartitions() < 12 * assets.sparkSession.sparkContext.defaultParallelism else rows
    last = dealt.groupBy("text_id").agg(F.max_by("text", F.struct("at", "text")).alias("text"))
    return settle(last.select("text_id", F.xxhash64("text").alias("h"), "text").mapInPandas(_parse_all, _PARSED))


def wrappers(pages: DataFrame) -> dict[str, tuple[Tree, frozenset]]:
    """Each host's wrapper and the numbers of its template nodes."""
    own = pages.select("host", "h", "tree")
    each = pages.select("host", "h", "size", "signs").dropDuplicates(["host", "h"]).select("host", "h", "size", F.explode("signs").alias("sign"))
    hosts = pages.groupBy("host").agg(F.countDistinct("h").alias("pages"))
    # only what most pages hold can be template, so the page to align to is one that holds most of it
    constant = each.groupBy("host", "sign").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host").where(F.col("n") >= CONSTANT * F.col("pages")).select("host", "sign")
    held = each.join(constant, ["host", "sign"]).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    # three pages at least hold what most pages of a host of three hold: Spark keeps FEWEST of each partition before the shuffle
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "size", "h"))
    best = held.withColumn("place", place).where(F.col("place") <= FEWEST).select("host", "h", "place")
    some: dict[str, dict[int, Tree]] = {}
    for r in own.join(best, ["host", "h"]).toLocalIterator():
        some.setdefault(r.host, {})[r.place] = json.loads(r.tree)
    shapes = {host: t for host, trees in some.items() if (t := shape([trees[k] for k in sorted(trees)])) is not None}
    held = pages.sparkSession.sparkContext.broadcast(shapes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for host, tree in zip(pdf.host, pdf.tree):
                if host in held.value:
                    seen[host, -1] += 1
                    seen.update({(host, k) for k, _ in agreed(held.value[host], json.loads(tree))})
        if seen:
            yield pd.DataFrame({"host": [h for h, _ in seen], "node": [k for _, k in seen], "n": list(seen.values())})

    counts: dict[str, dict[int, int]] = {}
    distinct = own.dropDuplicates(["host", "h"]).mapInPandas(count, "host string, node int, n bigint")
    for r in distinct.groupBy("host", "node").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.host, {})[r.node] = r.n
    return {host: (t, frozenset(k for k, n in counts.get(host, {}).items() if k >= 0 and n >= CONSTANT * counts[host][-1])) for host, t in shapes.items()}


def cleaned(assets: DataFrame) -> DataFrame:
    """(text_id, family, marked, elements, text) of each text: elements are array<struct<kind, text, content>>
    of its structural blocks, text is the clean printing of its content with its structure marked."""
    pages = _pages(assets)
    held = pages.sparkSession.sparkContext.broadcast(wrappers(pages))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, marked, tree in zip(pdf.host, pdf.marked, pdf.tree):
                blocks = roles(json.loads(tree), *held.value.get(host, (None, frozenset())))
                # elements are the text's own, whatever other pages repeat; only the printing loses the template
                elements = [{"kind": k, "text": t, "content": c} for k, t, c in blocks if k != "p"] if marked else []
                out.append((elements, "\n\n".join(PRINT[k].format(t) for k, t, c in blocks if c)))
            yield pd.DataFrame({"text_id": pdf.text_id, "family": pdf.family, "marked": pdf.marked, "elements": [e for e, _ in out], "text": [t for _, t in out]})

    return pages.drop("h", "size", "signs").mapInPandas(align, "text_id bigint, family string, marked boolean, elements array<struct<kind: string, text: string, content: boolean>>, text string")


def found(assets: DataFrame) -> DataFrame:
    """(text_id, elem_no, kind): 0 and 'markup' for each marked text, then its elements in order."""
    texts = cleaned(assets).where("marked")
    head = F.array(F.struct(F.lit(0).cast("bigint").alias("elem_no"), F.lit("markup").alias("kind")))
    rest = F.transform("elements", lambda e, i: F.struct((i + 1).cast("bigint").alias("elem_no"), e["kind"].alias("kind")))
    return texts.select("text_id", F.explode(F.concat(head, rest)).alias("x")).select("text_id", "x.*")

"""Noise in text from scanned pages: furniture, broken words, misread characters.

Furniture (running headers, footers, page numbers, filing lines) is found at the edges of pages: by
its form, by coming back on other pages of its document, or by being known from many documents. A word
broken at a line's end goes on in the next body line unless it is a suspended one ("pre- and
post-"), which the corpus shows by using it in mid-line. Characters are corrected by a noisy channel:
candidate words arise from character confusions with probabilities estimated on the corpus, and the
best sequence of candidates of a line is decoded by Viterbi under the corpus' word and bigram counts.
Names, which no word list holds, compete by a character trigram model trained on the corpus' names.

Scale: two narrow passes count words, bigrams and edge lines over all pages (partial aggregation
before the shuffle). Every word counts, however rare in the corpus, so results don't hang on its size;
the broadcast counts take 12 bytes for each distinct word and each bigram seen three times, and
confusions and name trigrams are summed up where the counts lie. Edge lines that recur in a document come back
to its pages by a join that keeps heavy keys out of the shuffle.

Defined results: null and empty pages have no lines; lines are split at line feeds and counted from 1
with blank ones; a null document_id has no sister pages; null or wrong page numbers don't move a page whose
image stands in order; repeated scans are pages of their own with the same neighbours, but don't make
a line recur and give no text; no word goes on over an unreadable page; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.hot_join import hot_join
from brindle.session import settle, spread

#: Bigrams seen less often, in a corpus of any size, say nothing about their words.
LEAST_BIGRAM = 3
#: Non-blank lines at either end of a page that may be furniture.
EDGE = 3
#: Documents that must repeat an edge line before it counts as furniture elsewhere too.
KNOWN_IN = 3
#: Gain in log-likelihood, beyond the channel's cost, for a corrected name.
NAME_GAIN = 1.5

# What is written, and what scanners take it for.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("o", "0"), ("i", "l"), ("d", "cl"), ("l", "1"), ("h", "li"), ("u", "ii"), ("w", "vv"), ("m", "rn"), ("g", "q"), ("ri", "n"), ("b", "8"), ("s", "5"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("cl", "d"), ("rn", "m"), ("i", "1"), ("l", "i"), ("c", "e"), ("f", "t"), ("z", "2"), ("g", "9"), ("ii", "u"), ("n", "ri"), ("vv", "w"), ("li", "h"),
)
#: Confusion probability where the corpus is too small to estimate it.
PRIOR = 0.003
HYPHENS = "-­‐¬="

_TOKEN = re.compile(r"[^\s\-­‐¬=—–/]+")
_STRIP = "“”\"'’‘.,;:()[]{}*!?"
_NUMBERLIKE = re.compile(r"[$§]?(?=[\dlIOoSsBZ,.]*\d)(?=[\d,.]*[lIOoSsBZ])[\dlIOoSsBZ]+(?:[,.][\dlIOoSsBZ]+)*")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|d|s)|\d+\([a-z0-9]\)?|\d+[a-h]", re.I)
_FORMS = re.compile(
    r"\s*(?:[\[(—–\-]*\s*(?:\d{1,4}|[ivxl]{1,6})\s*[\])—–\-]*"  # 12, - 12 -, [12], iv
    r"|[pP]a[gq][ec]\s+\S{1,4}(?:\s+[o0]f\s+\S{1,4})?|\d{1,4}\s*/\s*\d{1,4}"
    r"|\d{1,2}:\d{2}-[a-z]{2}-[\dlOoI]{3,7}(?:-[A-Z]{2,4})?"
    r"|C[ao]s[ec]\s+\S*\d:\S+\s.*|(?:\d{1,4}\s+)?C[il1]t[ec]\s+as:?\s.*"
    r"|(?:\d{1,4}\s+)?[^a-z]{2,}\s+v\.\s+[^a-z]{2,}|(?:\d{1,4}\s+)?[^a-z\s]{3,}(?: [^a-z\s]+)?, J\., \S+(?:\s+\d{1,4})?)\s*"
)
_SUSPENDED_BY = ("or", "and", "to", "nor", "through", "but")


def edge_key(line: str) -> str:
    """An edge line without numbers and spaces, its confusable characters folded together."""
    t = line.strip().lower().replace("rn", "m").replace("vv", "w").replace("ii", "u").replace("cl", "d").replace("li", "h")
    t = t.translate(str.maketrans("l|!cf015q8ﬁ", "iiietoisgbh"))
    # numbers of pages and dates go, digits inside words were letters
    t = re.sub(r"[^\w]+", " ", line.lower() if not t else t)
    return "".join(w for w in t.split() if not re.fullmatch(r"[\doisgb]{1,4}", w) or w.isalpha() and len(w) > 2)[:80]


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def edges_of(lines: list[str]) -> list[tuple[int, str]]:
    """(index, key) of the lines that may be furniture."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(i, edge_key(lines[i])) for i in dict.fromkeys(full[:EDGE] + full[-EDGE:])]


def furniture_of(lines: list[str], recurring: set[str], known: set[str]) -> set[int]:
    """Indices of furniture: runs from either edge inwards, so no body line lies outside of one."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    found: set[int] = set()
    for run in (full[:EDGE], full[::-1][:EDGE]):
        for i in run:
            key = edge_key(lines[i])
            short = len(lines[i].strip()) <= 120
            if short and (_FORMS.fullmatch(lines[i]) or (len(key) >= 3 and not _HEADING.fullmatch(lines[i]) and (key in known or key in recurring))):
                found.add(i)
            else:
                break
    return found


_HEADING = re.compile(r"\s*(?:[IVX]{1,5}|[A-H]|\d{1,2})\.(?:\s.*)?|\s*(?:\*\s*){3}\s*")


def spans_in(line: str) -> list[tuple[int, int]]:
    """Where a line's words stand, without the punctuation around them."""
    out = []
    for m in _TOKEN.finditer(line):
        bare = m[0].lstrip(_STRIP)
        start = m.end() - len(bare)
        bare = bare.rstrip(_STRIP)
        if bare and re.search(r"[^\W_]", bare):
            out.append((start, start + len(bare)))
    return out


def words_in(line: str) -> list[str]:
    return [line[a:b] for a, b in spans_in(line)]


def hyphen_end(line: str) -> str | None:
    """The last word of a line if it ends in a hyphen directly after a letter."""
    t = line.rstrip()
    m = re.search(rf"([^\W\d_][\w’']*)[{HYPHENS}]$", t)
    return m[1] if m else None


# ---- corpus statistics ---------------------------------------------------------------------


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    for pdf in batches:
        for text in pdf.ocr_text:
            for line in lines_of(text):
                own = words_in(line)
                inner = own[:-1] if hyphen_end(line) else own
                words.update("w " + w for w in inner)
                low = [w.lower() for w in inner]
                words.update("l " + w for w in low)
                words.update(f"b {a} {b}" for a, b in zip(low, low[1:]))
                # suspended words: a hyphen in mid-line before a conjunction
                words.update("s " + m[1].lower() for m in re.finditer(rf"(\w+)- (?:{'|'.join(_SUSPENDED_BY)})\b", line))
        if len(words) > 300_000:
            yield pd.DataFrame({"k": list(words), "n": list(words.values())})
            words = Counter()
    if words:
        yield pd.DataFrame({"k": list(words), "n": list(words.values())})


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


class Counts:
    """Counts of all keys ('w Word', 'l word', 'b two words', 's suspended') as sorted hashes."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order].astype(np.int64 if len(n) and n.max() > 2**31 - 1 else np.int32)

    def many(self, keys: list[str]) -> list[int]:
        if not len(self.hashes):
            return [0] * len(keys)
        wanted = np.fromiter(map(hash_of, keys), dtype=np.int64, count=len(keys))
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, self.n[at], 0).tolist()


class Model:
    """Noisy channel and language model over a table of counts; picklable."""

    def __init__(self, counts: Counts | dict[str, int], total: int):
        if isinstance(counts, dict):
            counts = Counts(np.array([hash_of(k) for k in counts], dtype=np.int64), np.array(list(counts.values()), dtype=np.int64))
        self.counts, self.total = counts, max(1, total)
        self.memory: dict[str, list[tuple[str, float]]] = {}
        self.looked: dict[str, int] = {}
        self.left: dict[str, float] = {}
        self.chance = {pair: PRIOR for pair in CONFUSIONS}
        self.grams: dict[str, int] = {}
        self.heads: dict[str, int] = {}

    def count(self, key: str) -> int:
        if key not in self.looked:
            self.prefetch([key])
        return self.looked[key]

    def prefetch(self, keys: list[str]) -> None:
        """Look up many keys at once."""
        if len(self.looked) > 500_000:
            self.looked.clear()
        self.looked.update(zip(keys, self.counts.many(keys)))

    def estimate(self, hits: dict[int, int], uses: dict[int, int]) -> None:
        """Chances of the confusions, from sums over all frequent words."""
        for i, pair in enumerate(CONFUSIONS):
            self.chance[pair] = min(0.02, max(2e-5, hits[i] / uses[i] if uses.get(i, 0) >= 20_000 else PRIOR))

    def clean(self, w: str, missing: float = 0.0) -> float:
        """What is left of a word's count once the misreadings of others are taken off."""
        n = self.count("l " + w)
        if not n:
            return missing
        if w not in self.left:
            if len(self.left) > 200_000:
                self.left.clear()
            sources = self.sources(w)
            seen = self.counts.many(["l " + v for v, _ in sources])
            self.left[w] = max(0.02, n - 3 * sum(m * p for m, (_, p) in zip(seen, sources) if m > n))
        return self.left[w]

    def suspended(self, word: str) -> bool:
        return self.count("s " + word) > 0

    def sources(self, seen: str) -> list[tuple[str, float]]:
        """Words that one confusion turns into what is seen, with its probability."""
        out: dict[str, float] = {}
        for (true, obs), p in self.chance.items():
            if obs in seen:
                for v in _edit(seen, obs, true):
                    out[v] = max(p, out.get(v, 0.0))
        return list(out.items())

    def name_score(self, word: str) -> float:
        t = f"^^{word.lower()}$"
        return sum(math.log((self.grams.get(t[i : i + 3], 0) + 0.05) / (self.heads.get(t[i : i + 2], 0) + 2.0)) for i in range(len(t) - 2))

    def known(self, word: str) -> bool:
        return self.clean(word) >= 2.0

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(candidate, log channel probability), the word itself first."""
        if word not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[word] = self._candidates(word)
        return self.memory[word]

    def _candidates(self, word: str) -> list[tuple[str, float]]:
        out = [(word, 0.0)]
        own = self.clean(word, 0.02)
        sources = self.sources(word)
        self.prefetch(["l " + v for v, _ in sources])
        for v, p in sources:
            if self.clean(v) * p * 4 > own and self.clean(v) >= 3.0:
                out.append((v, math.log(p)))
        if len(out) == 1 and own < 2.0 and len(word) >= 6:  # two confusions in one word
            twice = [(u, p, q) for v, p in sources for u, q in self.sources(v)]
            seen = self.counts.many(["l " + u for u, _, _ in twice])
            for n, (u, p, q) in zip(seen, twice):
                if n >= 20 and self.clean(u) >= 20.0:
                    out.append((u, math.log(p) + math.log(q)))
        return out

    def unigram(self, w: str) -> float:
        return self.clean(w, 0.02) / self.total

    def step(self, a: str, b: str) -> float:
        n = self.count(f"b {a} {b}")
        u = self.clean(a) if n else 0.0
        return math.log(0.7 * n / u + 0.3 * self.unigram(b)) if n and u >= n else math.log(0.3 * self.unigram(b))

    def decode(self, words: list[str]) -> list[str]:
        """The likeliest words behind a line's words, by Viterbi over their candidates."""
        if not words:
            return []
        lattice = [self.candidates(w) for w in words]
        if all(len(c) == 1 for c in lattice):
            return words
        score = [[p + math.log(self.unigram(c)) for c, p in lattice[0]]]
        back: list[list[int]] = [[0] * len(lattice[0])]
        for t in range(1, len(words)):
            row, ptr = [], []
            for c, p in lattice[t]:
                options = [s + self.step(prev, c) for s, (prev, _) in zip(score[-1], lattice[t - 1])]
                k = max(range(len(options)), key=options.__getitem__)
                row.append(options[k] + p)
                ptr.append(k)
            score.append(row)
            back.append(ptr)
        k = max(range(len(score[-1])), key=score[-1].__getitem__)
        out = []
        for t in range(len(words) - 1, -1, -1):
            out.append(lattice[t][k][0])
            k = back[t][k]
        return out[::-1]

    def mend_name(self, word: str) -> str:
        """A capitalised unknown word, or the likelier one a confusion made it from."""
        low = word.lower()
        base, own = self.name_score(low), self.count("w " + word)
        best, gain = word, NAME_GAIN
        for v, p in self.sources(low):
            if len(v) < 4 or not v.isalpha():
                continue
            seen = self.count("l " + v)
            g = self.name_score(v) - base + math.log(p) + (math.log((seen + 1) / (own + 0.5)) if seen > own else 0.0)
            if g > gain:
                best, gain = v, g
        return best


def _edit(word: str, old: str, new: str) -> Iterator[str]:
    at = word.find(old)
    while at >= 0:
        yield word[:at] + new + word[at + len(old) :]
        at = word.find(old, at + 1)


class Corrector:
    """Corrections of one worker, with a memory for words seen before."""

    def __init__(self, model: Model):
        self.model, self.names = model, {}

    def word(self, shown: str, decoded: str) -> str:
        """What a word should read."""
        if decoded != shown.lower():
            return _recase(shown, decoded)
        if "ﬁ" in shown or "ﬂ" in shown:
            return shown.replace("ﬁ", "fi").replace("ﬂ", "fl")
        if re.search(r"\d", shown):
            return self.mixed(shown)
        if shown[0].isupper() and len(shown) >= 5 and shown.isalpha() and not self.model.known(shown.lower()):
            if shown not in self.names:
                self.names[shown] = self.model.mend_name(shown)
            v = self.names[shown]
            return v if v == shown else _recase(shown, v)
        return shown

    def mixed(self, shown: str) -> str:
        """Words with digits in them: letters among digits, or digits among letters."""
        if shown.isdigit() or _ORDINAL.fullmatch(shown):
            return shown
        if _NUMBERLIKE.fullmatch(shown):
            return shown.translate(str.maketrans("lIOoSsBZ", "11005582"))
        letters = sum(c.isalpha() for c in shown)
        if letters >= 2 and letters > sum(c.isdigit() for c in shown) and re.search(r"[^\W\d_]\d|\d[^\W\d_]", shown) and not re.search(r"[$§(:]", shown):
            return _recase(shown, shown.lower().translate(str.maketrans("01589", "olsbg")))
        return shown


def _recase(shown: str, low: str) -> str:
    if shown.isupper() or (len([c for c in shown if c.isalpha()]) > 1 and not re.search("[a-z]", shown)):
        return low.upper()
    return low[:1].upper() + low[1:] if shown[:1].isupper() or (shown[:1].isdigit() and shown[1:2].isupper()) else low


def body_of(lines: list[str], gone: set[int]) -> list[int]:
    return [i for i in range(len(lines)) if i not in gone and lines[i].strip()]


def ends_of(text: str, recurring: set[str], known: set[str], model: Model) -> tuple[str | None, str | None, str | None]:
    """What a page shares with its neighbours: the first word of its body, the head of a word left
    open at its end, and that head where only the next page can tell whether it is a suspended one."""
    lines = lines_of(text)
    body = body_of(lines, furniture_of(lines, recurring, known))
    if not body:
        return None, None, None
    first, tail = words_in(lines[body[0]])[:1], hyphen_end(lines[body[-1]])
    return first[0] if first else None, tail, tail if tail and model.suspended(tail.lower()) else None


def is_compound(first: str, head: str, model: Model) -> bool:
    return model.known(first.lower()) and model.known(head.lower()) and not model.known((first + head).lower())


def slip_in(first: str, head: str, corrector: Corrector) -> int | None:
    """Where a broken word, judged as a whole, is misread: the position of its first wrong character."""
    whole = first + head
    if is_compound(first, head, corrector.model):
        return None
    right = corrector.word(whole, corrector.model.decode([whole.lower()])[0])
    return None if right == whole else next((n for n, (a, b) in enumerate(zip(whole, right)) if a != b), len(right))


def read_page(text: str, recurring: set[str], known: set[str], corrector: Corrector, before: str | None = None, after: str | None = None) -> list[tuple[int, str, str]]:
    """(line index, noise, line as it should read) of every noisy line, and '' for clean body lines.
    before is the head of a word left open on the page before, after the first word of the next page."""
    model, lines = corrector.model, lines_of(text)
    gone = furniture_of(lines, recurring, known)
    body = body_of(lines, gone)
    out = [(i, "furniture", "") for i in sorted(gone)]
    carry: tuple[int, str] | None = (-1, before) if before else None  # line and head of a broken word
    for k, i in enumerate(body):
        line = lines[i]
        spans = spans_in(line)
        own = [line[a:b] for a, b in spans]
        tail = hyphen_end(line)
        follow = words_in(lines[body[k + 1]])[:1] if k + 1 < len(body) else [after] if after else []
        broken = tail is not None
        if tail is not None and model.suspended(tail.lower()):
            # pre- or post-: the next word is a conjunction of its own
            broken = bool(follow) and follow[0].lower() not in _SUSPENDED_BY
        inner = own[:-1] if tail is not None and own else own
        head = None
        if carry is not None and own:
            head, inner, spans = own[0], inner[1:], spans[1:]
        fixed = [corrector.word(w, d) for w, d in zip(inner, model.decode([w.lower() for w in inner]))]
        bad = any(a != b for a, b in zip(inner, fixed))
        if carry is not None and head is not None:
            # the broken word as a whole: the wrong character lies in one part or the other
            j, first = carry
            if is_compound(first, head, model):
                bad |= any(corrector.word(w, model.decode([w.lower()])[0]) != w for w in (head,))
            elif (at := slip_in(first, head, corrector)) is not None:
                if at >= len(first):
                    bad = True
                elif j >= 0:  # else the line of the page before, which sees the whole word too
                    out.append((j, "misread", ""))
        if bad:
            out.append((i, "misread", ""))
        if broken:
            out.append((i, "hyphen", ""))
        carry = (i, tail) if broken and tail else None
        if carry and k + 1 == len(body) and after and (at := slip_in(tail, after, corrector)) is not None and at < len(tail):
            out.append((i, "misread", ""))
        if tail is not None and not broken and corrector.word(tail, model.decode([tail.lower()])[0]) != tail:
            out.append((i, "misread", ""))
        for (start, end), word in reversed(list(zip(spans, fixed))):
            line = line[:start] + word + line[end:]
        out.append((i, "", line))
    return list(dict.fromkeys(out))


def joined(above: str, below: str, corrector: Corrector) -> str:
    """Text that ends in a broken word with the text that goes on with it, the word mended as a whole."""
    first, rest = hyphen_end(above), words_in(below)[:1]
    if not first or not rest:
        return above + below
    at = below.index(rest[0])
    stem, head = above.rstrip()[: -1 - len(first)], rest[0]
    if is_compound(first, head, corrector.model):
        return above.rstrip() + below
    whole = first + head
    return stem + below[:at] + corrector.word(whole, corrector.model.decode([whole.lower()])[0]) + below[at + len(head) :]


def repaired(text: str, recurring: set[str], known: set[str], corrector: Corrector, before: str | None = None, after: str | None = None) -> str:
    """A page's body as paragraphs: furniture gone, characters mended, broken words joined."""
    rows = read_page(text, recurring, known, corrector, before, after)
    right = {i: line for i, noise, line in rows if not noise}
    broken = {i for i, noise, _ in rows if noise == "hyphen"}
    gone = {i for i, noise, _ in rows if noise == "furniture"}
    parts, glue, hung = [""], "", False
    for i, line in enumerate(lines_of(text)):
        if i in gone:
            continue
        if not line.strip():
            glue = glue if hung else "\n\n" if parts[-1] or len(parts) > 1 else ""
            continue
        t = right.get(i, line).strip()
        if hung:  # only the line with the word's head is touched
            parts[-1] = joined(parts[-1], t, corrector)
        else:
            parts += [glue, t]
        glue, hung = " ", i in broken
    return "".join(parts)


def in_order(pages: list[tuple[int, int | None, bool, frozenset]]) -> list[list[int]]:
    """Pages (image, number, readable, sketch) of one document in order, each with its other scans, as
    indices. Images are taken in page order unless most numbers say otherwise, so that a wrong or
    missing number moves no page; the pages then go by number, those without after the image before."""
    order = sorted(range(len(pages)), key=lambda i: pages[i][0])
    least: list[int] = []  # longest run of numbers that never fall
    for i in order:
        n = pages[i][1]
        if n is not None:
            at = bisect.bisect_right(least, n)
            least[at : at + 1] = [n]
    if len(least) * 3 < 2 * sum(p[1] is not None for p in pages):
        last, keyed = -math.inf, []
        for i in order:
            last = pages[i][1] if pages[i][1] is not None else last
            keyed.append((last, pages[i][0], i))
        order = [i for _, _, i in sorted(keyed)]
    out: list[list[int]] = []
    numbered: dict[int, list[int]] = {}
    for i in order:
        _, number, readable, sketch = pages[i]
        near = [*out[-2:][::-1], *([numbered[number]] if number in numbered else [])]
        twin = next((own for own in near if same_page(pages[own[0]], pages[i])), None)
        if twin is not None:
            twin.append(i)
            twin.sort(key=lambda k: (not pages[k][2], pages[k][0]))
            continue
        out.append([i])
        if number is not None:
            numbered.setdefault(number, out[-1])
    return out


#: Words of a page that tell whether two scans show the same page, and the share they must have in common.
SKETCH, ALIKE = 48, 0.4


def same_page(a: tuple, b: tuple) -> bool:
    if not (a[2] and b[2]):  # an unreadable scan of a page that has the same number
        return a[1] is not None and a[1] == b[1]
    if None not in (a[1], b[1]) and a[1] != b[1]:
        return False
    both = sorted(a[3] | b[3])[:SKETCH]
    return len(both) >= 4 and sum(h in a[3] and h in b[3] for h in both) >= ALIKE * len(both)


def sketch_of(text: str) -> list[int]:
    return sorted({hash_of(w.lower()) for line in lines_of(text) for w in words_in(line)})[:SKETCH]


# ---- over tables ---------------------------------------------------------------------------


def _pages(images: DataFrame) -> DataFrame:
    return spread(images.where("image_id is not null").where(F.length("ocr_text") > 0).select(F.col("image_id").cast("bigint").alias("image_id"), F.col("document_id").cast("bigint").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), "ocr_text"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": [hash_of(k) for k in pdf.k], "n": pdf.n})


def _sums(held):
    """Partial sums over the counts: hits and uses of each confusion, trigrams of names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, out = held.value, Counter()
        for pdf in batches:
            for k, n in zip(pdf.k, pdf.n):
                w = k[2:]
                if k[0] == "l" and n >= 300 and len(w) > 2 and w.isalpha():
                    for i, (true, seen) in enumerate(CONFUSIONS):
                        for m in counts.many(["l " + v for v in _edit(w, true, seen)]):
                            if m <= 0.03 * n:
                                out[f"hits {i}"] += m
                                out[f"uses {i}"] += n
                # capitalised words that aren't common words
                elif k[0] == "w" and w[0].isupper() and w.isalpha() and len(w) >= 5 and counts.many(["l " + w.lower()])[0] < 2 * n + 1:
                    t = f"^^{w.lower()}$"
                    for i in range(len(t) - 2):
                        out["gram " + t[i : i + 3]] += 1
                        out["head " + t[i : i + 2]] += 1
        if out:
            yield pd.DataFrame({"k": list(out), "n": list(out.values())})

    return run


def train(pages: DataFrame) -> Model:
    counts = settle(pages.select("ocr_text").mapInPandas(_count, "k string, n bigint").groupBy("k").agg(F.sum("n").cast("bigint").alias("n")))
    total = counts.where(F.col("k").startswith("w ")).agg(F.sum("n")).first()[0] or 0
    kept = counts.where(~F.col("k").startswith("b ") | (F.col("n") >= LEAST_BIGRAM)).mapInPandas(_hashed, "h bigint, n bigint").toArrow()
    table = Counts(kept["h"].to_numpy(), kept["n"].to_numpy())
    held = pages.sparkSession.sparkContext.broadcast(table)
    words = counts.where(F.col("k").startswith("w ") | F.col("k").startswith("l ") & (F.col("n") >= 300))
    sums: dict[str, dict] = {"hits": {}, "uses": {}, "gram": {}, "head": {}}
    for r in words.mapInPandas(_sums(held), "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        kind, _, k = r.k.partition(" ")
        sums[kind][int(k) if kind in ("hits", "uses") else k] = r.n
    model = Model(table, total)
    model.estimate(sums["hits"], sums["uses"])
    model.grams, model.heads = sums["gram"], sums["head"]
    return model


def _edge_rows(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image, doc, page, text in zip(pdf.image_id, pdf.document_id, pdf.page_number, pdf.ocr_text):
                body = re.sub(r"\W+", "", text)
                out += [(image, doc, key, f"{hash_of(body)}", page) for key in dict.fromkeys(k for _, k in edges_of(lines_of(text))) if len(key) >= 3]
            if out:
                yield pd.DataFrame(out, columns=["image_id", "document_id", "key", "h", "page"]).astype({"page": "Int32", "document_id": "Int64"})

    return pages.mapInPandas(run, "image_id bigint, document_id bigint, key string, h string, page int")


def _recurring(pages: DataFrame) -> tuple[DataFrame, set[str]]:
    """(image_id, keys): a page's edge lines that come back on other pages; and the edge lines
    that recur in KNOWN_IN documents or more."""
    edges = settle(_edge_rows(pages))
    # a page scanned twice is one page: by its text, and by its number where it has one
    seen = edges.where("document_id is not null").groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n"), F.least(F.approx_count_distinct("h"), F.approx_count_distinct(F.coalesce(F.col("page").cast("string"), F.col("h")))).alias("pages"))
    again = settle(seen.where("pages > 1").select("document_id", "key", "n"))
    docs = again.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    every = again.select("document_id").distinct().count()
    # at most EDGE * 2 keys a page recur, and each kept key takes KNOWN_IN documents and a share of all
    least = max(KNOWN_IN, math.ceil(1e-4 * every))
    known = {r.key for r in docs.where(F.col("docs") >= least).toLocalIterator()}
    keys = hot_join(edges.select("image_id", "document_id", "key").where("document_id is not null"), again, ["document_id", "key"], "n")
    return keys.groupBy("image_id").agg(F.collect_set("key").alias("keys")), known


def _with_model(images: DataFrame):
    pages = _pages(images)
    model = train(pages)
    keys, known = _recurring(pages)
    held = pages.sparkSession.sparkContext.broadcast((model, known))
    pages = settle(pages.join(keys, "image_id", "left"))
    return pages.join(_placed(images, pages, held), "image_id", "left"), held


def _placed(images: DataFrame, pages: DataFrame, held) -> DataFrame:
    """(image_id, before, after, seat): the open head on the page before, the first word of the
    next page, and the page's place in its document (null for another scan of a page)."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = held.value
        for pdf in batches:
            out = [(*ends_of(t, set(k if k is not None else ()), known, model), sketch_of(t)) for t, k in zip(pdf.ocr_text, pdf["keys"])]
            yield pd.DataFrame({"image_id": pdf.image_id, "document_id": pdf.document_id, "page_number": pdf.page_number.astype("Int32"), "first": [x[0] for x in out], "tail": [x[1] for x in out], "doubt": [x[2] for x in out], "sketch": [x[3] for x in out]})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rows in pdf.rows:
                seats = in_order([(r["image_id"], r["page_number"], r["sketch"] is not None, frozenset(r["sketch"] if r["sketch"] is not None else ())) for r in rows])
                for k, own in enumerate(seats):
                    head = rows[seats[k - 1][0]] if k else None
                    nxt = rows[seats[k + 1][0]] if k + 1 < len(seats) else None
                    for n, i in enumerate(own):
                        r = rows[i]
                        before = head["tail"] if head is not None else None
                        if before and head["doubt"] and (r["first"] or "").lower() in _SUSPENDED_BY:
                            before = None
                        out.append((r["image_id"], before, nxt["first"] if nxt is not None else None, None if n else k))
            yield pd.DataFrame(out, columns=["image_id", "before", "after", "seat"]).astype({"seat": "Int64"})

    # unreadable pages keep their place: no word goes on over them
    shape = "image_id bigint, document_id bigint, page_number int, first string, tail string, doubt string, sketch array<bigint>"
    ended = pages.where("document_id is not null").select("image_id", "document_id", "page_number", "ocr_text", "keys").mapInPandas(ends, shape)
    blank = images.where("image_id is not null and document_id is not null").where(F.coalesce(F.length("ocr_text"), F.lit(0)) == 0)
    blank = blank.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("document_id").cast("bigint").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), *(F.lit(None).cast(t).alias(c) for c, t in (("first", "string"), ("tail", "string"), ("doubt", "string"), ("sketch", "array<bigint>"))))
    rows = ended.unionByName(blank).groupBy("document_id").agg(F.collect_list(F.struct("image_id", "page_number", "first", "tail", "doubt", "sketch")).alias("rows"))
    return rows.select("rows").mapInPandas(place, "image_id bigint, before string, after string, seat bigint").groupBy("image_id").agg(F.min(F.struct(F.col("seat").isNull(), "seat", "before", "after")).alias("x")).select("image_id", "x.seat", "x.before", "x.after")


def noise(images: DataFrame) -> DataFrame:
    """(image_id, line_no, noise) of every noisy line."""
    pages, held = _with_model(images)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = held.value
        corrector = Corrector(model)
        for pdf in batches:
            out = []
            for image, text, keys, before, after in zip(pdf.image_id, pdf.ocr_text, pdf["keys"], pdf.before, pdf.after):
                out += [(image, i + 1, kind) for i, kind, _ in read_page(text, set(keys if keys is not None else ()), known, corrector, before, after) if kind]
            if out:
                yield pd.DataFrame(out, columns=["image_id", "line_no", "noise"])

    return pages.select("image_id", "ocr_text", "keys", "before", "after").mapInPandas(run, "image_id bigint, line_no bigint, noise string").distinct()


def _clean(images: DataFrame):
    pages, held = _with_model(images)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = held.value
        corrector = Corrector(model)
        for pdf in batches:
            texts = [repaired(t, set(k if k is not None else ()), known, corrector, b, a) for t, k, b, a in zip(pdf.ocr_text, pdf["keys"], pdf.before, pdf.after)]
            # the last line ends in a broken word if the next page goes on with it
            hung = [bool(h := hyphen_end(t)) and not (model.suspended(h.lower()) and (not a or a.lower() in _SUSPENDED_BY)) for t, a in zip(texts, pdf.after)]
            yield pd.DataFrame({"document_id": pdf.document_id.astype("Int64"), "page_number": pdf.page_number.astype("Int32"), "image_id": pdf.image_id, "text": texts, "seat": pdf.seat.astype("Int64"), "hung": hung})

    return pages.mapInPandas(run, "document_id bigint, page_number int, image_id bigint, text string, seat bigint, hung boolean"), held


def clean_pages(images: DataFrame) -> DataFrame:
    """(document_id, page_number, image_id, text): each page's body in repaired paragraphs."""
    return _clean(images)[0].select("document_id", "page_number", "image_id", "text")


def clean_documents(images: DataFrame) -> DataFrame:
    """(document_id, image_id, pages, text): each document's pages in page order as continuous
    paragraphs, with its first image and number of pages; a page without a document stands alone."""
    done, held = _clean(images)
    alone = done.where("document_id is null").select("document_id", "image_id", F.lit(1).cast("bigint").alias("pages"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corrector = Corrector(held.value[0])
        for pdf in batches:
            texts = []
            for rows in pdf.rows:
                parts: list[str] = []
                last = None
                for r in rows:
                    if not r["text"]:
                        continue
                    if last is not None and last["hung"] and r["seat"] == last["seat"] + 1:
                        parts[-1] = joined(parts[-1], r["text"], corrector)
                    elif last is not None:
                        # a paragraph goes on unless a sentence has ended
                        ended = re.search(r"[.?!:;*][\"”’')\]]*$", last["text"].rstrip()) or _HEADING.fullmatch(r["text"].split("\n")[0])
                        parts += ["\n\n" if ended else " ", r["text"]]
                    else:
                        parts.append(r["text"])
                    last = r
                texts.append("".join(parts))
            yield pd.DataFrame({"document_id": pdf.document_id, "image_id": [r[0]["image_id"] for r in pdf.rows], "pages": [len(r) for r in pdf.rows], "text": texts})

    held_rows = F.array_sort(F.collect_list(F.struct("seat", "image_id", "text", "hung"))).alias("rows")
    whole = done.where("document_id is not null and seat is not null").groupBy("document_id").agg(held_rows).mapInPandas(run, "document_id bigint, image_id bigint, pages bigint, text string")
    return whole.unionByName(alone)

"""Garbled text from wrong character encodings, found and restored by description length.

A decoding chain is one or two steps "these characters are really the bytes of encoding W, which
were written in encoding R". Every chain that applies is tried on the windows around the non-ASCII
characters of a text (every one of them, over the whole text), first on the whole text, then line
by line for texts garbled in part. Each candidate is compressed with one zstandard dictionary per
language; its description length is the smallest of these sizes plus the chain's own cost in bytes.
The shortest description wins; the unchanged text has no chain cost, so it stays unless a chain
pays for itself.

The only fitted models are a dictionary and an alphabet per language, from all labelled rows in which
no chain of multi-byte sequences applies, equal texts once. Letters are counted over all of them.
Dictionaries are trained in parts of about PART_BYTES, then on the parts' dictionaries, level by level,
until one is left, so that no task holds more than a part and the driver gets one for each language.
Scoring covers all rows and is a narrow map without a shuffle.

Defined results: null, empty and pure ASCII texts are clean; a text holding U+FFFD lost characters
in a wrong decoding and is found although it can't be restored; a language without such rows has
no dictionary; without any, plain zstandard sizes decide; repeated rows each count; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from brindle.session import settle, spread

LANGUAGES = ("en", "es", "fr", "de", "pl", "ru")
#: Text that one dictionary is trained on at once, and the size of a dictionary.
PART_BYTES = 4_000_000
DICTIONARY_BYTES = 96_000
#: Characters kept on both sides of a non-ASCII run.
CONTEXT = 20

# Encodings text is mistaken for, and pairs (mistaken for, written in) of single-byte ones.
UTF8_SEEN_AS = ("cp1252", "mac_roman", "cp1250", "cp437", "cp850", "cp1251", "iso8859_2", "koi8_r", "cp866", "iso8859_15", "cp1254")
SINGLE = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp1250"),
    ("cp1251", "cp1250"), ("cp1252", "iso8859_2"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"), ("cp437", "cp1252"),
    ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1251"), ("mac_roman", "cp1250"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"),
)
#: Cost of a step in bytes: the cost of naming it among all steps, more for steps that need no valid sequence.
UTF8_COST, SINGLE_COST = 1, 3

#: Description cost of a character outside all alphabets, in bytes.
ESCAPE = 2
#: A character belongs to an alphabet from so many texts on, and from this share of the language's texts.
ALPHABET_DOCS, ALPHABET_SHARE = 3, 3 / 800

_BYTES = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
_WINDOW = re.compile(rf"[^\n]{{0,{CONTEXT}}}[^\x00-\x7f](?:[^\n]{{0,{2 * CONTEXT}}}[^\x00-\x7f])*[^\n]{{0,{CONTEXT}}}")
# What a sequence may decode to: Latin, Cyrillic and signs, and the characters that
# Latin ones look like after one more mistake (C1 controls, mathematical signs, box drawing, ligatures).
_SENSIBLE = re.compile("[\u0080-\u017f\u0192\u02c6-\u02dd\u03a9\u03c0\u0400-\u045f\u0490\u0491\u2010-\u203a\u2044\u20ac\u2116\u2122\u2202-\u2265\u2310-\u2321\u2500-\u25ca\ufb01\ufb02]")


@lru_cache(maxsize=None)
def upper_half(encoding: str) -> str:
    """The characters of bytes 128..255; an undefined byte stands for itself."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(128, 256))


@lru_cache(maxsize=None)
def _to_bytes(encoding: str) -> dict[int, int]:
    table = {ord(c): b for b, c in enumerate(upper_half(encoding), 128)}
    for b in range(128, 160):  # C1 controls survive most mistaken decodings as they are
        table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def _runs(encoding: str) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_to_bytes(encoding))) + "]{2,}")


def as_utf8(text: str, seen_as: str) -> str:
    """Valid UTF-8 sequences among the characters' bytes become the characters they encode."""
    table = _to_bytes(seen_as)

    def mend(m: re.Match) -> str:
        raw, out, at = bytes(table[ord(c)] for c in m[0]), [], 0
        for s in _BYTES.finditer(raw):
            if _SENSIBLE.match(c := s[0].decode()):
                out += [m[0][at : s.start()], c]
                at = s.end()
        return "".join(out) + m[0][at:]

    return _runs(seen_as).sub(mend, text)


@lru_cache(maxsize=None)
def _single_table(seen_as: str, written_in: str) -> dict[int, str]:
    upper = upper_half(written_in)
    return {c: upper[b - 128] for c, b in _to_bytes(seen_as).items()}


def as_single(text: str, seen_as: str, written_in: str) -> str:
    """Every non-ASCII character re-read; the text itself where one of them is not of seen_as."""
    table = _single_table(seen_as, written_in)
    if any(ord(c) > 127 and ord(c) not in table for c in text):
        return text
    return text.translate(table)


Step = tuple[str, str]
STEPS: list[tuple[Step, int]] = [((w, "utf_8"), UTF8_COST) for w in UTF8_SEEN_AS] + [(pair, SINGLE_COST) for pair in SINGLE]


def redecode(text: str, chain: tuple[Step, ...]) -> str:
    for seen_as, written_in in chain:
        text = as_utf8(text, seen_as) if written_in == "utf_8" else as_single(text, seen_as, written_in)
    return text


_CONTROL = re.compile(r"[\x80-\x9f]")
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_MIXED = re.compile("[A-Za-z](?=[\u0400-\u045f])|[\u0400-\u045f](?=[A-Za-z])")


class Measure:
    """Description lengths under the dictionaries and alphabets of all languages."""

    def __init__(self, models: dict[str, tuple[bytes, str]]):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders, self.alphabet = [], {c for _, letters in models.values() for c in letters}
        for data, letters in models.values():
            d = z.ZstdCompressionDict(data)
            d.precompute_compress(compression_params=params)
            self.coders.append((z.ZstdCompressor(dict_data=d, compression_params=params), frozenset(letters)))
        self.coders = self.coders or [(z.ZstdCompressor(compression_params=params), frozenset())]

    def size(self, text: str) -> int:
        raw, signs = text.encode("utf-8", "surrogatepass"), _FOREIGN.findall(text)
        return min(len(c.compress(raw)) + ESCAPE * sum(s not in letters for s in signs) for c, letters in self.coders) + ESCAPE * len(_MIXED.findall(text))

    def steps(self, text: str) -> Iterator[tuple[Step, int, str]]:
        """Steps that change the text, with their cost and result; equal results once."""
        seen, signs = {text}, set(_FOREIGN.findall(text))
        for step, cost in STEPS:
            if step[1] != "utf_8" and (table := _single_table(*step)) is not None and not all(table.get(ord(c)) in self.alphabet for c in signs):
                continue
            tried = redecode(text, (step,))
            if tried not in seen:
                seen.add(tried)
                yield step, cost, tried

    def chain(self, windows: str) -> tuple[Step, ...]:
        """The chain of least description length, () for the text as it is."""
        known: tuple[Step, ...] = ()
        spent, base, least = 0, windows, None
        for _ in range(3):
            tries = list(self.steps(base))
            if tries and least is None:
                least = self.size(base)
            raw = len(base.encode("utf-8", "surrogatepass"))
            # a single-byte step leaves the characters' number alone: what UTF-8 alone saves is no gain
            slack = lambda step, t: 0 if step[1] == "utf_8" else raw - len(t.encode("utf-8", "surrogatepass"))  # noqa: E731, B023
            best = min(((self.size(t) + slack(step, t) + spent + cost, cost, step, t) for step, cost, t in tries), default=None)
            if best is None or best[0] >= least:
                break
            least, cost, step, base = best
            known, spent = (*known, step), spent + cost
        return known


def windows_of(text: str) -> str:
    return "\n".join(_WINDOW.findall(text))


def restore(text: str, measure: Measure) -> tuple[str, list[tuple[Step, ...]]]:
    """The text with the least description, and the chains that led to it."""
    chains: list[tuple[Step, ...]] = []
    whole = windows_of(text)
    if not whole:
        return text, chains
    chain = measure.chain(whole)
    if chain:
        chains.append(chain)
        text = redecode(text, chain)
    lines = text.split("\n")
    if len(lines) > 1:
        for i, line in enumerate(lines):
            if (part := windows_of(line)) and (chain := measure.chain(part)):
                chains.append(chain)
                lines[i] = redecode(line, chain)
        text = "\n".join(lines)
    return text, chains


# Encodings in which clean texts of these languages hold no valid sequence.
_TELLING = ("cp1252", "mac_roman", "cp1250", "cp437", "cp850")


def _plainly_garbled(text: str) -> bool:
    """Whether a row is unfit as an example of clean text."""
    return "�" in text or bool(_CONTROL.search(text)) or any(as_utf8(text, w) != text for w in _TELLING)


def dictionary_of(texts: list[bytes]) -> bytes:
    """Dictionary (at most DICTIONARY_BYTES) of texts, or of the contents of other dictionaries."""
    import zstandard as z

    # long texts are cut into pieces for the trainer; all of the pieces are kept
    kept = [raw[i : i + 2000] for raw in texts for i in range(0, len(raw), 2000)]
    try:
        return z.train_dictionary(DICTIONARY_BYTES, kept, level=3).as_bytes()
    except z.ZstdError:  # too little text for a trained dictionary: its text itself serves
        return z.ZstdCompressionDict(b"".join(kept)[:DICTIONARY_BYTES] or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT).as_bytes()


_PART = "lang string, raw binary, n bigint, letters array<string>, counts array<bigint>"


def _train_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Dictionary of a part's clean texts, their number, and how many of them each letter is in."""
    texts = sorted({t for t in pdf.text if not _plainly_garbled(t)})
    signs = Counter(c for t in texts for c in set(_FOREIGN.findall(t)))
    raw = dictionary_of([t.encode("utf-8", "surrogatepass") for t in texts])
    return pd.DataFrame({"lang": [key[0]], "raw": [raw], "n": [len(texts)], "letters": [list(signs)], "counts": [list(signs.values())]})


def _train_again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [key[0]], "raw": [dictionary_of(sorted(map(bytes, pdf.raw)))]})


def _dealt(rows: DataFrame, of: str) -> tuple[GroupedData, list[str]]:
    """Rows grouped by language into parts of PART_BYTES, equal ones together, and the languages of one part."""
    sizes = {r.lang: math.ceil(r.n / PART_BYTES) for r in rows.groupBy("lang").agg(F.sum(F.octet_length(of)).alias("n")).collect()}
    parts = F.try_element_at(F.create_map(*[F.lit(x) for p in sizes.items() for x in p]), F.col("lang")) if sizes else F.lit(1)
    return rows.groupBy("lang", F.pmod(F.xxhash64(of), parts).alias("part")), [x for x, n in sizes.items() if n == 1]


def train(documents: DataFrame) -> dict[str, tuple[bytes, str]]:
    """The model of each language, from all of its rows."""
    rows = documents.where(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 0)).select("lang", "text")
    dealt, done = _dealt(rows, "text")
    level = settle(dealt.applyInPandas(_train_part, _PART)).where("n > 0")
    texts = {r.lang: r.n for r in level.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not texts:
        return {}
    letters = level.select("lang", F.explode(F.arrays_zip("letters", "counts")).alias("x")).groupBy("lang", F.col("x.letters").alias("c")).agg(F.sum("x.counts").alias("n"))
    alphabets = {x: "" for x in texts}
    for r in sorted(letters.toLocalIterator()):
        if r.n >= max(ALPHABET_DOCS, ALPHABET_SHARE * texts[r.lang]):
            alphabets[r.lang] += r.c
    level, data = level.select("lang", "raw"), {}
    while True:
        data |= {r.lang: bytes(r.raw) for r in level.where(F.col("lang").isin(done)).collect()}
        level = level.where(~F.col("lang").isin(done))
        if level.isEmpty():
            return {x: (data[x], alphabets[x]) for x in sorted(texts)}
        dealt, done = _dealt(level, "raw")
        level = settle(dealt.applyInPandas(_train_again, "lang string, raw binary"))


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, chains, lossy, text) of every garbled document; lossy: characters are lost for good."""
    held = documents.sparkSession.sparkContext.broadcast(train(documents))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = Measure(held.value)
        for pdf in batches:
            out = []
            for i, text in zip(pdf.doc_id, pdf.text):
                mended, chains = restore(text, measure)
                if chains or "�" in text:
                    out.append((i, " | ".join(" > ".join(f"{w}:{r}" for w, r in c) for c in dict.fromkeys(chains)), "�" in mended, mended))
            yield pd.DataFrame(out, columns=["doc_id", "chains", "lossy", "text"])

    rows = documents.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInPandas(scan, "doc_id bigint, chains string, lossy boolean, text string")

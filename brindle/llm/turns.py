"""Speech transcripts into clean speaker turns.

A hearing arrives as timed segments, as a written transcript, or both. Timed pieces are swept in
order of their start; a piece that repeats the end of what was just said (a rolling caption) keeps
only its new words, found by the longest suffix-prefix overlap; labels are matched to the
participants by edit distance over the forms a name takes; turns end where the speaker changes.
Pauses longer than the hearing's own calibrated gap (median + 3 median deviations) split a turn's
text into paragraphs.

All of it happens inside one row, so the work is a narrow map; only the small finished turns are
shuffled, to keep one row per re-ingested hearing: the row with most turns, then the latest, then
the smallest turns in text order.

Defined results: a hearing without spoken words has no turns; a null id gives no rows; a label that
matches no participant counts as no label; words before any label go to the first speaker named
after them, or to null where none is; a null or repeated start keeps the piece's place in the list;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.aligning import edits, fold

# Hesitations that are no words of a turn.
FILLERS = ("uh-huh", "mm-hmm", "you know", "i mean", "um", "uh", "er", "erm", "hmm", "mm", "ah", "eh")
# Titles and tails around a speaker's name.
TITLES = ("chief", "justice", "judge", "mr", "mrs", "ms", "miss", "dr", "hon", "honorable", "the", "counsel", "attorney", "prof")
TAILS = ("j", "jj", "cj", "esq", "jr", "sr")

_NOTE = re.compile(r"\[[^\]\n]{0,80}\]|\{[^}\n]{0,80}\}|\*[^*\n]{1,40}\*|<[^>\n]{1,40}>|♪|(?<!\w)\([^()\n]{2,60}\)")
_STAMP = re.compile(r"[\[(]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\b[\])]?")
_FILLER = re.compile(r"(?<![\w-])(?:" + "|".join(FILLERS) + r")(?![\w-])[,.]?(?:\s*--)?", re.I)
_WORD = re.compile(r"\w+(?:['’-]\w+)*")
_LEAD = re.compile(r"^\s*(?:>>+\s*)?(?:[\[(](\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)[\])]\s*)?(?:>>+\s*)?(.*)$", re.S)
_RANGE = re.compile(r"^\s*(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s*-->\s*(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s*$")
_LABEL = re.compile(r"^([^:\n]{1,60}?)\s*(?:[\[(](\d{1,2}:\d{2}(?::\d{2})?)[\])]\s*)?(?:\s*:\s+|:\s*$|\s+[-–—]\s+)(.*)$", re.S)


def clean_speech(text: str | None) -> str:
    """The spoken words of a piece: no stamps, sound notes, fillers or stuttered repeats."""
    text = _NOTE.sub(" ", _STAMP.sub(" ", text or ""))
    text = _FILLER.sub(" ", text)
    text = re.sub(r"\b([\w'’-]{1,40})(?:\s+\1\b)+", r"\1", text)
    text = re.sub(r"\s+([,.;:?!])", r"\1", re.sub(r"\s+", " ", text)).strip()
    text = re.sub(r"^(?:[-–—,.;]+\s*)+|\s*(?:--|–|—)+$", "", text).strip()
    return text if _WORD.search(text) else ""


def _seconds(stamp: str | None) -> float | None:
    if not stamp:
        return None
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


class Names:
    """Labels of one hearing to its participants."""

    def __init__(self, participants: list[str]):
        self.forms: list[tuple[str, int]] = []
        self.known: dict[str, int | None] = {}
        for k, name in enumerate(participants):
            words = [w for w in re.findall(r"[^\s,.]+", fold(name)) if w not in TAILS]
            if words:
                first, last = words[0], words[-1]
                for form in {" ".join(words), last, f"{first} {last}", f"{first[0]} {last}", f"{last} {first}"}:
                    self.forms.append((form, k))

    def find(self, label: str | None) -> int | None:
        if label is None or not label.strip():
            return None
        if label not in self.known:
            self.known[label] = self._find(label)
        return self.known[label]

    def _find(self, label: str) -> int | None:
        words = re.findall(r"[^\s,.]+", fold(label))
        while words and words[0] in TITLES and len(words) > 1:
            words.pop(0)
        while words and words[-1] in TAILS and len(words) > 1:
            words.pop()
        text = " ".join(words)
        if len(words) > 4 or not text:
            return None
        most = max(1, len(text) // 4)
        best = min(((edits(text, form, most), abs(len(text) - len(form)), k) for form, k in self.forms), default=(99, 0, 0))
        return best[2] if best[0] <= most else None


def timed_pieces(index, names: Names) -> list[tuple[float | None, float | None, int | None, str]]:
    return [(p.get("start_seconds"), p.get("end_seconds"), names.find(p.get("speaker")), p.get("text") or "") for p in index if p is not None]


def written_pieces(transcript: str, names: Names) -> list[tuple[float | None, float | None, int | None, str]]:
    """Pieces of a written transcript in any of the usual layouts. A line without label or stamp
    goes on with the piece before it."""
    pieces: list = []
    start = end = None
    for line in transcript.split("\n"):
        if not line.strip() or re.fullmatch(r"\s*\d+\s*", line):
            continue
        if m := _RANGE.match(line):
            start, end = _seconds(m[1]), _seconds(m[2])
            pieces.append((start, end, None, ""))
            continue
        stamp, rest = _LEAD.match(line).groups()
        speaker, said, labelled = None, rest, False
        if m := _LABEL.match(rest):
            speaker = names.find(m[1])
            if speaker is not None or re.match(r"(?i)\s*(?:un(?:identified|known)|speaker)\b", m[1]):
                said, labelled, stamp = m[3], True, stamp or m[2]
        if stamp:
            start, end = _seconds(stamp), None
        if labelled or stamp or not pieces:
            pieces.append((start, end, speaker, said))
        else:
            s, e, k, text = pieces[-1]
            pieces[-1] = (s, e, k, f"{text} {said}")
    return pieces


def sweep(pieces: list) -> list:
    """Pieces in order of speaking; one without a start stays behind the piece before it."""
    keyed, at = [], float("-inf")
    for i, p in enumerate(pieces):
        at = p[0] if p[0] is not None and p[0] == p[0] else at
        keyed.append((at, i, p))
    return [p for *_, p in sorted(keyed, key=lambda x: x[:2])]


def new_words(said: list[str], text: str) -> str:
    """text without the longest prefix (of two words or more) that ends what was said."""
    words = text.split()
    low = [w.lower().strip(".,;?!") for w in words]
    if not low:
        return ""
    # border array of text + separator + tail of said: its last entry is the overlap
    chain = [*low, None, *said[-len(low) :]]
    border = [0] * len(chain)
    for i in range(1, len(chain)):
        k = border[i - 1]
        while k and chain[i] != chain[k]:
            k = border[k - 1]
        border[i] = k + (chain[i] == chain[k])
    overlap = border[-1] if said else 0
    return " ".join(words[overlap:]) if overlap >= 2 else text


def turns_of(transcript: str | None, index, participants) -> list[tuple[int, str | None, float | None, str]]:
    """(turn_no, speaker, start_seconds, text) of one hearing."""
    people = [p for p in (participants if participants is not None else []) if p]
    names = Names(people)
    timed = sweep(timed_pieces(index if index is not None else [], names))
    written = sweep(written_pieces(transcript, names)) if transcript else []
    # both hold the same turns; the one that names more of its pieces says more surely whose they are
    named = lambda ps: sum(k is not None for _, _, k, _ in ps)
    pieces = timed if timed and named(timed) >= named(written) else written or timed
    gaps = [b[0] - a[1] for a, b in zip(pieces, pieces[1:]) if a[1] is not None and b[0] is not None and b[0] >= a[1]]
    mid = median(gaps) if gaps else 0.0
    pause = mid + 3 * median(abs(g - mid) for g in gaps) if gaps else float("inf")
    turns: list[list] = []
    now: int | None = None
    said: list[str] = []
    ended = None
    for start, end, k, text in pieces:
        text = clean_speech(text)
        now = k if k is not None and (text or k is not None) else now
        if not text:
            continue
        fresh = new_words(said, text) if turns and turns[-1][0] == now else text
        if not fresh:
            continue
        said += [w.lower().strip(".,;?!") for w in fresh.split()]
        if turns and turns[-1][0] == now:
            gap = "\n" if ended is not None and start is not None and start - ended > pause else " "
            turns[-1][2] += gap + fresh
        elif turns and turns[-1][0] is None:
            turns[-1][0], turns[-1][2] = now, f"{turns[-1][2]} {fresh}"
        else:
            turns.append([now, start, fresh])
        ended = end
    return [(n, people[k] if k is not None else None, start, text) for n, (k, start, text) in enumerate(turns, 1)]


_SCHEMA = "audio_id bigint, ingested_at timestamp_ntz, turns array<struct<turn_no: bigint, speaker: string, start_seconds: double, text: string>>"


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [turns_of(t, x, p) for t, x, p in zip(pdf.transcript, pdf.timestamp_index, pdf.participants)]
        yield pd.DataFrame({"audio_id": pdf.audio_id, "ingested_at": pdf.ingested_at, "turns": [[dict(zip(("turn_no", "speaker", "start_seconds", "text"), t)) for t in turns] for turns in out]})


def speaker_turns(assets: DataFrame) -> DataFrame:
    """(audio_id, turn_no, speaker, start_seconds, text) of every hearing."""
    rows = assets.where("audio_id is not null").select(F.col("audio_id").cast("bigint").alias("audio_id"), F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), "transcript", "timestamp_index", "participants")
    done = rows.mapInPandas(_batches, _SCHEMA)
    kept = done.groupBy("audio_id").agg(F.max_by("turns", F.struct(F.size("turns"), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.xxhash64(F.to_json("turns")))).alias("turns"))
    return kept.select("audio_id", F.explode("turns").alias("t")).select("audio_id", "t.*")

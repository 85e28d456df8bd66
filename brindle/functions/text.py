"""Scalar text functions as Column expressions."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities that nearly all pages get by with.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&mdash;": "—", "&ndash;": "–", "&sect;": "§", "&amp;": "&"}


def _unescaped(body: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else html.unescape(t).replace("\xa0", " ")), "string")(body)  # type: ignore[call-overload]


def collapse_space(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def strip_html(body: Column) -> Column:
    """Text without tags, entities decoded, white space collapsed. The usual entities are decoded by
    built-in functions, any others, of which there are thousands, by the standard library's table."""
    bare = F.regexp_replace(body, r"<[^>]*>", " ")
    out = bare
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    usual = "|".join(e[1:-1] for e in ENTITIES)
    rare = bare.rlike(rf"&(?!(?:{usual});)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    return collapse_space(F.when(rare, _unescaped(F.when(rare, bare))).otherwise(out))


def first_text(*columns: Column, limit: int = 20_000) -> Column:
    """The first column with any text, cleaned and cut."""
    return F.left(F.coalesce(*(F.nullif(strip_html(c), F.lit("")) for c in columns)), F.lit(limit))


def cite_string(volume: Column, reporter: Column, page: Column) -> Column:
    return F.when(volume.isNotNull() & reporter.isNotNull() & page.isNotNull(), F.concat_ws(" ", volume.cast("string"), reporter, page.cast("string")))


def labelled(limit: int = 6000, **parts: Column) -> Column:
    """'Label: text' paragraphs of those parts that have text."""
    rows = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{name.replace('_', ' ').capitalize()}: "), F.trim(c))) for name, c in parts.items()]
    return F.left(F.concat_ws("\n\n", *rows), F.lit(limit))


def lenient_date(text: Column) -> Column:
    """The date in a text's first ten characters, or null."""
    day = F.left(text, F.lit(10))
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def date_in_title(title: Column) -> Column:
    """'... Month d, yyyy ...' as a date, or null."""
    found = F.regexp_extract(title, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("MMMM d, yyyy")).cast("date")


def numeric_id(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def name_parts(name: Column) -> dict[str, Column]:
    """First, middle and last name of 'Last, First Middle' or 'First Middle Last'."""
    comma = F.contains(name, F.lit(","))
    plain = F.when(comma, F.concat_ws(" ", F.trim(F.split_part(name, F.lit(","), F.lit(2))), F.trim(F.split_part(name, F.lit(","), F.lit(1))))).otherwise(name)
    words = F.split(collapse_space(plain), " ")
    n = F.size(words)
    return {"first": F.when(n > 1, words[0]), "middle": F.when(n > 2, F.array_join(F.slice(words, 2, F.greatest(n - 2, F.lit(0))), " ")), "last": F.try_element_at(words, F.lit(-1))}


def audio_start(segments: Column, word: str) -> Column:
    """Start of the first segment whose text has the word."""
    return F.try_element_at(F.filter(segments, lambda s: F.contains(F.lower(s["text"]), F.lit(word.lower()))), F.lit(1))["start_seconds"]


#: Hits of one word that an excerpt shows.
HITS = 12


def excerpt(body: Column, words: list[str], window: int = 350, limit: int = 4000) -> Column:
    """Windows of text around the first HITS places of each word, merged where they touch, in the
    text's order, joined and cut; the text's beginning where no word stands in it."""

    def cut(text: str | None) -> str | None:
        if text is None or len(text) <= limit:
            return text
        low, spans = text.lower(), []
        for w in words:
            places = [m.start() for _, m in zip(range(HITS), re.finditer(re.escape(w.lower()), low))]
            spans += [(max(0, at - window), at + len(w) + window) for at in places]
        parts: list[list[int]] = []
        for a, b in sorted(spans):
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], b)
            else:
                parts.append([a, b])
        return ("\n…\n".join(text[a:b] for a, b in parts) or text)[:limit]

    return F.pandas_udf(lambda s: s.map(cut), "string")(body)  # type: ignore[call-overload]


def verdict(reply: Column) -> Column:
    """{match, confidence, rationale} of a model's reply: its first complete JSON object after any
    thinking, whatever it nests; anything unreadable is no match at no confidence."""

    def parse(text: str | None) -> tuple:
        bare = re.sub(r"(?s)<think>.*?(?:</think>|$)", "", text or "")
        decoder = json.JSONDecoder()
        for m in re.finditer(r"\{", bare):
            try:
                got = decoder.raw_decode(bare, m.start())[0]
            except ValueError:
                continue
            sure = got.get("confidence", 0.0)
            said = got.get("rationale")
            return got.get("match") is True, float(sure) if isinstance(sure, (int, float)) else 0.0, None if said is None else str(said)
        return False, 0.0, None

    run = lambda s: pd.DataFrame([parse(t) for t in s], columns=["match", "confidence", "rationale"])
    return F.pandas_udf(run, "match boolean, confidence double, rationale string")(reply)  # type: ignore[call-overload]


#: Characters of a token, and tokens a prompt and its answer take of a model's context.
PER_TOKEN, PROMPT_TOKENS, ANSWER_TOKENS = 3.5, 256, 160


def fitted(body: Column, context: int) -> Column:
    """The part of a text that a model with so many tokens of context can be shown."""
    return F.left(body, F.lit(max(0, int((context - PROMPT_TOKENS - ANSWER_TOKENS) * PER_TOKEN))))


def content(**fields: Column) -> Column:
    """{source, text}: the first of the named fields that holds any text, trimmed, and its name."""
    full = {name: F.nullif(F.trim(c), F.lit("")) for name, c in fields.items()}
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(F.lit(name).alias("source"), c.alias("text"))) for name, c in full.items()))


def media_content(text: Column, images: Column, audio: Column) -> Column:
    """{kind, ref, text}: a record as text where it has any, else its first image, else its recording."""
    made = lambda kind, ref, body: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), body.alias("text"))
    none = F.lit(None).cast("string")
    return F.when(F.length(F.trim(text)) > 0, made("text", none, text)).when(F.size(images) > 0, made("image", F.try_element_at(images, F.lit(1)), none)).when(F.length(audio) > 0, made("audio", audio, none))


def display_title(title: Column, doc_type: Column, case_name: Column) -> Column:
    """A record's title; an oral argument goes by the name of its case."""
    return F.coalesce(F.when(doc_type == "oral_argument", F.nullif(F.trim(case_name), F.lit(""))), F.nullif(F.trim(title), F.lit("")), F.lit("Untitled"))


def primary_url(source_url: Column, external_page: Column, pdf: Column) -> Column:
    """Where a record is shown: its source, else its page elsewhere, else its scan."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (source_url, external_page, pdf)))


def media_links(**links: Column) -> Column:
    """array<struct<kind, url>> of the media a record has, in the order given, each address once."""
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), F.nullif(F.trim(c), F.lit("")).alias("url")) for kind, c in links.items()))
    full = F.filter(made, lambda m: m["url"].isNotNull())
    return F.filter(full, lambda m, i: ~F.exists(F.slice(full, F.lit(1), i), lambda o: o["url"] == m["url"]))


def json_at(body: Column, *path: str) -> Column:
    """The value at a path of a JSON text, as text."""
    return F.get_json_object(body, "$" + "".join(f"['{p}']" if not p.isdigit() else f"[{p}]" for p in path))


def json_with(body: Column, **values: Column) -> Column:
    """A JSON object text with some of its keys set; null and unreadable texts count as empty objects."""
    held = F.coalesce(F.from_json(body, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keys = F.array(*map(F.lit, values))
    kept = F.map_filter(held, lambda k, _: ~F.array_contains(keys, k))
    return F.to_json(F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])))


def place(name: Column, city: Column, region: Column, latitude: Column, longitude: Column) -> Column:
    """A location record, null where nothing of it is known."""
    made = F.struct(name.alias("name"), city.alias("city"), region.alias("region"), latitude.try_cast("double").alias("latitude"), longitude.try_cast("double").alias("longitude"))
    return F.when(F.coalesce(name, city, region, latitude.cast("string"), longitude.cast("string")).isNotNull(), made)


def page_link(ref: Column, page: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(ref, F.lit("#page="), page.cast("string"))).otherwise(ref)

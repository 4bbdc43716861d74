"""Tokenising, query parsing, snippets and highlighting as Column expressions.

Every function takes and gives Columns; the ``*_literal`` forms do the same for one Python string,
for queries that the driver holds anyway.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.stem import stem_word

# The stop words, removed before stemming.
STOP_WORDS = ("a", "an", "the", "is", "are", "am", "and", "or", "of", "to", "in", "for", "on", "at", "by", "with", "from", "as", "this", "that", "it", "not", "be", "was")
# What counts as white space when snippets split a query and page text is folded.
SPACE_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SNIPPET, LEAD = 200, 60
#: Least length of a token in documents; in queries tokens of one letter count too.
DOCUMENT_LEAST, QUERY_LEAST = 2, 1


def tokens(text: Column, least: int = DOCUMENT_LEAST) -> Column:
    """Words in order: lower case, everything but a-z and 0-9 parts them, stop words go."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def token_count(text: Column) -> Column:
    """How many tokens() a document has, counted in one pass that makes no array of them."""
    stops = "|".join(w for w in STOP_WORDS if len(w) >= DOCUMENT_LEAST)
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9])(?!(?:{stops})(?![a-z0-9]))[a-z0-9]{{{DOCUMENT_LEAST},}}+"))


def tokens_literal(text: str, least: int = QUERY_LEAST) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9]+", (text or "").lower()) if len(w) >= least and w not in STOP_WORDS]


def parse_query(query: str) -> tuple[list[str], list[list[str]]]:
    """Distinct stemmed terms in order, and the quoted phrases that keep more than one token."""
    terms = list(dict.fromkeys(map(stem_word, tokens_literal(query))))
    quoted = (list(map(stem_word, tokens_literal(q))) for q in re.findall(r'"([^"]+)"', query or ""))
    return terms, [p for p in quoted if len(p) > 1]


def query_phrases(query: Column) -> Column:
    """The unstemmed tokens of each quoted phrase with more than one."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), 1)
    return F.filter(F.transform(quoted, lambda q: tokens(q, QUERY_LEAST)), lambda p: F.size(p) > 1)


def snippet(content: Column, query: Column) -> Column:
    """About 200 characters around the first query word, in the query's order, that the content
    holds; without one the first 200; empty for empty content. Offsets count code points."""
    words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), SPACE_CLASS + "+"), lambda w: F.length(w) > 1)
    size = F.length(content)

    def shown(at: Column) -> Column:
        start = F.greatest(at - LEAD, F.lit(0))
        end = F.least(start + SNIPPET, size)
        around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, start + 1, end - start), F.when(end < size, "...").otherwise(""))
        head = F.concat(F.substring(content, 1, SNIPPET), F.when(size > SNIPPET, "...").otherwise(""))
        return F.when(at.isNull(), head).otherwise(around)

    hits = once(F.lower(content), lambda low: F.filter(F.transform(words, lambda w: F.position(w, low)), lambda p: p > 0))
    at = once(hits, lambda h: F.when(F.size(h) > 0, F.element_at(h, 1) - 1))
    return F.when(content.isNull() | (content == ""), "").otherwise(once(at, shown))


def once(value: Column, then) -> Column:
    """then(value), where the value is worked out once a row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight(text: Column, query: str) -> Column:
    """HTML of the text with each query word, any case, in a mark element."""
    words = [w for w in re.split(r"\s+", (query or "").strip().lower().replace('"', "")) if w]
    safe = escape_html(text)
    if not words:
        return safe
    return F.regexp_replace(safe, "(?i)(" + "|".join(re.escape(w) for w in words) + ")", '<mark class="highlight">$1</mark>')


def last_word(query: Column) -> Column:
    """The word that autocomplete looks up: the last one, if query and word have two characters."""
    trimmed = F.trim(query)
    word = F.element_at(F.split(trimmed, r"\s+"), -1)
    return F.when((F.length(trimmed) >= 2) & (F.length(word) >= 2), word)


def complete(query: Column, suggestion: Column) -> Column:
    """The query with its last word replaced by the suggestion."""
    parts = F.split(F.trim(query), r"\s+")
    return F.concat_ws(" ", F.slice(parts, 1, F.size(parts) - 1), F.array(suggestion))


def display_score(score: Column) -> Column:
    return F.format_string("%.3f", score)

"""Normalisation and tokens of texts, on the driver and as expressions.

Columns stay in the JVM: tags, entities, case and splitting are built-in functions, and accents too where a text only
has characters of the Latin blocks.  Other texts (and those with rare entities) go through one Arrow UDF.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHORTEST, LONGEST = 2, 64
_TAG = re.compile(r"<[^>]*>")
#: A character reference: one that no semicolon ends is text.
_REFERENCE = r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);"
_ENTITY = re.compile(_REFERENCE)
_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def _character(entity: re.Match) -> str:
    """What a reference stands for; itself, if its name is not known as a whole."""
    return html.unescape(entity[0]) if entity[1][0] == "#" else html5.get(f"{entity[1]};", entity[0])


def fold(text: str) -> str:
    """Without tags, entities, upper case and combining marks."""
    text = _ENTITY.sub(_character, _TAG.sub("", text)).lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").strip()


def tokenize(text: str | None) -> list[str]:
    """Runs of letters and digits of 2 to 64 characters, in order, with repeats."""
    return [t for t in _WORD.split(fold(text or "")) if SHORTEST <= len(t) <= LONGEST]


def folding() -> tuple[str, str]:
    """Lower-case Latin characters with a mark and the letters that they fold to, from the character database."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xE0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.category(x) == "Mn" for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Characters beyond ASCII that need no more than case and marks mapped: Latin blocks (without İ), dashes, quotes, currencies.
LATIN = "".join(chr(c) for low, high in ((0x80, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)) for c in range(low, high + 1) if c != 0x130)


@F.pandas_udf(StringType())
def _fold_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def folded(column: Column) -> Column:
    """`fold` of a column; null stays null.

    Marked Latin letters are mapped in the JVM. A text goes to the UDF if it has an entity other than the basic ones, a
    combining mark or a character beyond the Latin blocks.
    """
    bare = F.when(column.contains("<"), F.regexp_replace(column, r"<[^>]*>", "")).otherwise(column)
    plain = bare
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    marked, letters = folding()
    lower = F.lower(plain)
    mapped = F.when(_beyond_ascii(lower), F.translate(lower, marked, letters)).otherwise(lower)
    # Lengths tell what a text has beyond ASCII and Latin; a pattern tried at each character would take most of the time.
    other = _beyond_ascii(column) & _beyond_ascii(F.translate(column, LATIN, ""))
    other = other | (column.contains("&") & bare.rlike(rf"&(?!(lt|gt|quot|nbsp|amp);){_REFERENCE[1:]}"))
    # Whether a text is for the UDF is worked out once, for its input; null from it is a text that isn't.
    return F.coalesce(_fold_any(F.when(other, column)), F.trim(mapped))


def _beyond_ascii(column: Column) -> Column:
    return F.octet_length(column) > F.length(column)


def tokens(column: Column) -> Column:
    """`tokenize` of a column, an array; empty for null."""
    parts = F.split(folded(column), r"[^\p{L}\p{N}]+")
    return F.coalesce(F.filter(parts, lambda t: F.length(t).between(SHORTEST, LONGEST)), F.array().cast("array<string>"))


def word_list(entries) -> set[str]:
    """The tokens of a list of stopwords."""
    return {t for e in entries for t in tokenize(e)}


def synonym_map(groups, stopwords: set[str]) -> dict[str, list[str]]:
    """token -> further tokens to index at its weight, from comma-separated groups; stopwords are no synonyms."""
    out: dict[str, set[str]] = {}
    for group in groups:
        words = sorted({t for part in (group.split(",") if isinstance(group, str) else group) for t in tokenize(part)} - stopwords)
        for word in words if len(words) > 1 else ():
            out.setdefault(word, set()).update(w for w in words if w != word)
    return {k: sorted(v) for k, v in out.items()}


def query_tokens(query: str, stopwords: set[str]) -> list[str]:
    return [t for t in tokenize(query) if t not in stopwords]


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(column), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")

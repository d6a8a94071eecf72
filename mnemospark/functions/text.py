"""Text columns: normal forms, token sets, similarity, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

#: White space as Python's str.split has it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def lines(text: Column) -> Column:
    """The lines of a text, as Python's str.splitlines has them."""
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def token_set(text: Column) -> Column:
    """Distinct tokens between white space, as they are written; none of an empty text."""
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda t: t != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def compare_form(text: Column) -> Column:
    """Folded case, punctuation as spaces, white space collapsed."""
    folded = F.regexp_replace(F.lower(text), "ß", "ss")
    return normalize(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]", " "))


def form_tokens(form: Column) -> Column:
    """The token set of a text in compare_form."""
    return F.array_distinct(F.filter(F.split(form, " "), lambda t: t != ""))


def compare_tokens(text: Column) -> Column:
    return form_tokens(compare_form(text))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(set_jaccard(a, b))


def flat(text: Column) -> Column:
    return F.lower(normalize(text))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def content_tokens(text: Column) -> Column:
    """Tokens that name something: no function words, no numbers."""
    left = F.array_except(_tokens(text), F.array(*map(F.lit, words.FUNCTION_WORDS + words.NUMBER_WORDS)))
    return F.filter(left, lambda t: ~t.rlike("^[0-9]+(st|nd|rd|th)?$"))


def number_tokens(text: Column) -> Column:
    """Tokens with a digit, and number words."""
    return F.filter(_tokens(text), lambda t: t.rlike("[0-9]") | t.isin(*words.NUMBER_WORDS))


def sets_differ(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) > 0


def contains_any(text: Column, found: tuple[str, ...]) -> Column:
    out = text.contains(found[0])
    for w in found[1:]:
        out = out | text.contains(w)
    return out


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Any of the phrases as whole words."""
    return text.rlike(rf"(?<!{WORD})({'|'.join(phrases)})(?!{WORD})")


def has_negation(text: Column) -> Column:
    return has_phrase(F.lower(text), words.NEGATION)


def has_strong_update(text: Column) -> Column:
    return has_phrase(F.lower(text), words.STRONG)


def has_weak_update(text: Column) -> Column:
    return has_phrase(F.lower(text), words.WEAK)


def has_change_signal(text: Column) -> Column:
    return has_phrase(F.lower(text), words.NEGATION + words.STRONG + words.WEAK)


def excerpt(text: Column, limit: int = 120) -> Column:
    short = normalize(text)
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit - 3), F.lit("..."))).otherwise(short)

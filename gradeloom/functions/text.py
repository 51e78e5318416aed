"""Response-text expressions. All are native Column expressions; none is a Python UDF."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from gradeloom import fixed_values as fv


def stripped(text: Column) -> Column:
    """Text without leading and trailing whitespace (all Unicode spaces).

    Trimming by a set of characters lays out every character of the text, so it is left to texts that start or end with one of them.
    """
    spaces = F.lit(fv.WHITESPACE)
    at_the_ends = F.contains(spaces, F.substring(text, 1, 1)) | F.contains(spaces, F.substring(text, -1, 1))
    return F.when(at_the_ends, F.btrim(text, spaces)).otherwise(text)


def is_blank(text: Column) -> Column:
    """NULL, empty or whitespace only."""
    return F.coalesce(stripped(text), F.lit("")) == ""


def folded(text: Column) -> Column:
    """Lower case, with the letters that match ``i`` and ``s`` when case is ignored written as those.

    Replacing looks up every character, so only texts that hold one of the three are replaced.
    """
    lookalikes = "\u0130\u0131\u017f"
    return F.lower(F.when(_any_of(text, list(lookalikes)), F.translate(text, lookalikes, "iis")).otherwise(text))


def answer_choice(body: Column, lowered: Column) -> Column:
    """Letter A-D named by the text; NULL when no pattern matches.

    ``body`` is the stripped text and ``lowered`` its ``folded`` form; make both columns
    first, they are read many times. A pattern is only run when the text holds a
    substring the pattern cannot match without, so most texts cost a few substring
    searches and one or two regular expressions.
    """
    cases = F
    for pattern, needed in fv.ANSWER_PATTERNS:
        hit = _any_of(lowered, needed) & body.rlike(pattern)
        cases = cases.when(hit, F.upper(F.regexp_extract(body, pattern, 1)))
    return cases.otherwise(F.lit(None).cast("string"))


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def error_head(text: Column) -> Column:
    """The part of a text that is searched for API errors."""
    return F.substring(F.lower(F.substring(text, 1, fv.API_ERROR_WINDOW)), 1, fv.API_ERROR_WINDOW)


def api_error(text: Column, body: Column, head: Column) -> Column:
    """Issue name for empty, error-like and suspiciously short texts, else NULL.

    ``body`` is the stripped text, ``head`` its ``error_head`` as a column.
    """
    phrases = F.array(*[F.lit(p) for p in fv.API_ERROR_PHRASES])
    first_phrase = F.get(F.filter(phrases, lambda phrase: F.contains(head, phrase)), F.lit(0))
    # only texts of a few characters are lower-cased again here
    short = (F.length(body) < fv.SHORT_RESPONSE_LENGTH) & ~F.startswith(F.lower(body), F.lit("answer"))
    return F.when(F.coalesce(text, F.lit("")) == "", "EMPTY_RESPONSE").otherwise(
        F.coalesce(F.concat(F.lit("API_ERROR: "), first_phrase), F.when(short, "SUSPICIOUSLY_SHORT"))
    )


def likely_error(lowered: Column) -> Column:
    """True when the lower-cased text holds any error or refusal word."""
    return F.coalesce(_any_of(lowered, fv.LIKELY_ERROR_WORDS), F.lit(False))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded down; 0 for missing text."""
    body = stripped(text)  # else leading and trailing space would leave empty pieces
    words = F.when(F.coalesce(body, F.lit("")) == "", 0).otherwise(F.size(F.split(body, rf"(?U)[{fv.WS_CLASS}]+")))
    return F.floor(words * F.lit(1.3)).cast("int")


def token_bucket(tokens: Column) -> Column:
    """Half-open token classes."""
    return (
        F.when(tokens < 20, "<20")
        .when(tokens < 100, "20-100")
        .when(tokens < 300, "100-300")
        .when(tokens >= 300, ">300")
    )


def preview(text: Column, length: int) -> Column:
    """First characters of a text for display, ``NULL`` spelled out when missing."""
    return F.coalesce(F.substring(text, 1, length), F.lit("NULL"))


def answer_letter(index: Column) -> Column:
    """0-based answer index to letter; NULL when missing or out of range."""
    letters = F.array(*[F.lit(x) for x in fv.ANSWER_LETTERS])
    return F.when(index >= 0, F.get(letters, index.cast("int")))

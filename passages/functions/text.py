"""Text expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define tokens and the clean-up of reranker input.
ASCII_WORD = "[a-zA-Z0-9]+"
WORD = r"[\p{L}\p{N}]+"
NO_WORD_BEYOND_ASCII = r"[^\x00-\x7F\p{L}\p{N}]+"
TOKEN = r"[ \t\n\r]*(?:[\p{L}\p{N}_]+|[^ \t\n\r\p{L}\p{N}_])"
TIGHT_PUNCTUATION = r"(?<=[\p{L}\p{N}_])([?.,!])(?![\s\p{Z}])"
CAMEL_HUMP = "([a-z0-9])([A-Z])"
BASIC_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{Z}\p{L}\p{N}_]"
SPACES = r"(?U)\s+"


def document_tokens(text: Column) -> Column:
    """Lower-case ASCII words; every other character separates (accented letters too)."""
    return F.transform(F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_text(text: Column) -> Column:
    """Lower case, with a space for characters beyond ASCII that are no letters or digits.

    What ASCII letters and digits and all characters beyond ASCII spell is then what `words` gives.
    """
    return F.regexp_replace(F.lower(text), NO_WORD_BEYOND_ASCII, " ")


def query_tokens(text: Column, normalize: bool = False) -> Column:
    """Lower-case words cut at white space only, so that `foo?` never meets `foo`.

    normalize=True uses the rule for documents instead.
    """
    if normalize:
        return document_tokens(text)
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def space_tight_punctuation(text: Column) -> Column:
    """A space before ? . , ! that follows a word and is not followed by white space."""
    return F.regexp_replace(text, TIGHT_PUNCTUATION, " $1")


def drop_markup_characters(text: Column) -> Column:
    spaced = F.translate(text, "_-#", "   ")
    return F.translate(F.replace(spaced, F.lit(".html"), F.lit("")), ".", " ")


def split_camel_case(text: Column) -> Column:
    """fooBar -> foo Bar, with white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CAMEL_HUMP, "$1 $2"), SPACES, " "))


def preprocess(text: Column) -> Column:
    """Reranker input: punctuation spaced, markup dropped, camel case split, basic tokens."""
    cleaned = split_camel_case(drop_markup_characters(space_tight_punctuation(text)))
    return F.array_join(F.regexp_extract_all(F.lower(cleaned), F.lit(BASIC_TOKEN), F.lit(0)), " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pieces(text: Column) -> Column:
    """Tokens with their leading white space, so that joining them gives the text back."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(pieces(text))


def trim_tokens(text: Column, limit: int | Column) -> Column:
    """The first `limit` tokens: a true prefix of the text."""
    count = F.lit(limit) if isinstance(limit, int) else limit
    return F.array_join(F.slice(pieces(text), F.lit(1), count), "")

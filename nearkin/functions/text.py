"""Text expressions: whitespace, hashes, tokens, chunks. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as whitespace when text is cleaned
# or split (a plain \s misses 23 of them).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The same set as a regular expression, other than the plain space. Latin-1
# members are listed one by one, which the matcher keeps as a bit set, and the
# others sit behind one range test that ordinary letters fail at once.
_OTHER = (
    r"\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0085\u00a0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
_ANY = f"[{_OTHER} ]"
# Runs that are not already a single plain space.
_UNTIDY = f"[{_OTHER}]{_ANY}*+| {_ANY}++"


def clean_text(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip both ends."""
    return F.btrim(F.regexp_replace(text, _UNTIDY, " "))


def strip(text: Column) -> Column:
    """Strip whitespace of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def embed_input(text: Column) -> Column:
    """Newlines to spaces, then strip: the form in which text is embedded."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def text_id(text: Column) -> Column:
    """SHA-1 hex of the text's UTF-8 bytes."""
    return F.sha1(text)


def content_id(content: Column) -> Column:
    """SHA-1 hex of raw bytes."""
    return F.sha1(content)


def tokens(text: Column) -> Column:
    """Whitespace tokens. Blank text gives one empty token, which is no word."""
    return F.split(strip(text), _ANY + "++")


def token_count(text: Column) -> Column:
    """Number of whitespace tokens, none for blank text."""
    return F.when(strip(text) == "", F.lit(0)).otherwise(F.size(tokens(text)))


# Ranges of scripts that are written without spaces (Thai, Lao,
# Myanmar, Khmer, kana, Han and their compatibility forms).
_UNSPACED = (
    r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9d"
    r"\x{20000}-\x{3ffff}"
)
MAX_WORD_CHARS = 64
_WORD = f"(?:[{_UNSPACED}]|[^ {_UNSPACED}]{{1,{MAX_WORD_CHARS}}}+)"


def chunk_words(cleaned: Column, size: int) -> Column:
    """Cut cleaned text into runs of at most ``size`` words.

    A character of a script without spaces is a word, and a longer run than
    ``MAX_WORD_CHARS`` is several, cut between code points, so no chunk is without
    bound. One pass of a regular expression that never backtracks. Slices of a
    token array would need the array once per chunk, and it is costly to build.
    """
    run = f"{_WORD}(?: ?{_WORD}){{0,{int(size) - 1}}}+"
    return F.regexp_extract_all(cleaned, F.lit(run), F.lit(0))


def chunk_chars(text: Column, size: int) -> Column:
    """Cut text into runs of at most ``size`` code points, never mid-character."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{int(size)}}}+"), F.lit(0))


def drop_blank(chunks: Column) -> Column:
    """Remove chunks that hold only whitespace."""
    return F.filter(F.transform(chunks, embed_input), lambda c: c != "")


def preview(text: Column, size: int, suffix: str = "") -> Column:
    """The first ``size`` code points, followed by ``suffix``."""
    return F.concat(F.substring(text, 1, size), F.lit(suffix))

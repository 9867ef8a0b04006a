"""Native tokenizer expressions for the review word-frequency job.

The notebook lower-cases a review, deletes ASCII punctuation, splits on any
whitespace (Python ``str.split()``), and keeps alphabetic tokens that are not
stop words. Each step is a built-in Spark expression here -- no Python UDF --
so tokenisation runs JVM-side inside whole-stage codegen.

The two character classes are written out so Java regex (Spark) and RE2
(DuckDB oracle) read them identically; Java's ``\\s`` would miss U+00A0 and
RE2's ``\\s`` would miss U+000B.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Python's string.punctuation (32 ASCII characters) and the
# characters str.split() treats as whitespace, as regex classes.
# ---------------------------------------------------------------------------
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"
WHITESPACE_RUN = (
    r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
LETTERS_ONLY = r"^\p{L}+$"


def normalise(text: Column) -> Column:
    """lower-case, then delete (not blank) ASCII punctuation: don't -> dont."""
    return F.regexp_replace(F.lower(text), PUNCTUATION_CLASS, "")


def tokens(text: Column) -> Column:
    """Array of whitespace-separated pieces of the normalised text."""
    return F.split(normalise(text), WHITESPACE_RUN)


def is_word(token: Column) -> Column:
    """str.isalpha(): one or more letters and nothing else (drops empty pieces)."""
    return token.rlike(LETTERS_ONLY)

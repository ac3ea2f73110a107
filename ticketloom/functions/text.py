"""Text expressions: comparison form, counts, ticket normalization, categories."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the data model.
PLACEHOLDER = r"(?i)^(?:n/?a|none|null|nan|test|todo|placeholder|no description|not available|[-_.]+)$"
URL = r"(?i)(?:https?://|www\.)[^\s<>()\[\]{}]+"
URL_SIGNAL = r"(?i)https?://|www\."
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
TAG = r"<[^>]+>"
MARKUP = r"(?i)<[^>]+>|\{code\}|\{noformat\}"
STACK_TRACE = r"(?i)traceback|exception|\bat\s+[\w.$]+\([^)]*:\d+\)"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{feff}]"
LITERAL_ESCAPE = r"\\[nrt]"
ANGLE_TOKEN = r"<[a-zA-Z_]{1,20}>"
PROTECTED = ("name", "tel_num", "email_address", "url")


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def comparison_form(c: Column) -> Column:
    """Lower case, literal escapes and white space as one space, no space at either end; null is empty."""
    spaced = F.regexp_replace(F.lower(or_empty(c)), LITERAL_ESCAPE, " ")
    return F.trim(F.regexp_replace(spaced, r"[\s ​]+", " "))


def word_count(c: Column, unescape: bool = True) -> Column:
    """Runs of letters, digits and underscores; literal escapes are blanks if unescape."""
    text = or_empty(c)
    if unescape:
        text = F.regexp_replace(text, LITERAL_ESCAPE, " ")
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


@F.pandas_udf(StringType())
def unescape_nfkc(s: pd.Series) -> pd.Series:
    """HTML entities resolved, then Unicode NFKC; null stays null."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def normalize_markup(c: Column) -> Column:
    """The part of ticket normalization that needs no Python; null stays null.

    Literal escapes become blanks; protected tokens survive in lower case while
    other tags go; addresses become tokens; control characters become blanks
    and zero-width ones vanish; white space is collapsed.
    """
    out = F.regexp_replace(c, LITERAL_ESCAPE, " ")
    for name in PROTECTED:
        out = F.regexp_replace(out, rf"(?i)<{name}>", f"⦃{name}⦄")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(out, TAG, " ")
    for name in PROTECTED:
        out = F.replace(out, F.lit(f"⦃{name}⦄"), F.lit(f"<{name}>"))
    out = F.regexp_replace(out, URL, "<url>")
    out = F.regexp_replace(out, EMAIL, "<email_address>")
    out = F.regexp_replace(out, CONTROL, " ")
    out = F.regexp_replace(out, ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def normalize_ticket(c: Column) -> Column:
    """Full ticket normalization; entities and compatibility forms are resolved first."""
    return normalize_markup(unescape_nfkc(c))


def clean_category(c: Column, lower: bool = False) -> Column:
    """White space collapsed and trimmed, blank as null, lower case if asked."""
    out = F.trim(F.regexp_replace(c.cast("string"), r"[\s ]+", " "))
    out = F.when(out != "", out)
    return F.lower(out) if lower else out


def truth(c: Column) -> Column:
    """Text as boolean: true, 1 and yes hold, all else doesn't; null is null."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def group_key(c: Column) -> Column:
    return F.sha1(c)

"""String predicates and path helpers as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a change as a fix (loose form).
FIX_WORDS = (
    "fix", "bug", "defect", "error", "fault", "issue",
    "patch", "correct", "resolve", "close", "closes",
    "closed", "hotfix", "regression", "revert",
)

# Issue-reference patterns.
ISSUE_REFERENCES = (
    r"fix(?:es|ed)?\s+#\d+",
    r"close(?:s|d)?\s+#\d+",
    r"resolve(?:s|d)?\s+#\d+",
    r"bug\s+#\d+",
)

# Alternatives of the strict, word-bounded fix pattern.
STRICT_FIX_TERMS = (
    r"fix(es|ed|ing)?",
    r"bug(fix|s)?",
    r"defect(s)?",
    r"regression(s)?",
    r"crash(es|ed|ing)?",
    r"segfault",
    r"deadlock",
    r"memory[\s_-]?leak",
    r"stack[\s_-]?overflow",
    r"infinite[\s_-]?loop",
    r"null[\s_-]?pointer",
    r"index[\s_-]?error",
    r"key[\s_-]?error",
    r"attribute[\s_-]?error",
    r"type[\s_-]?error",
    r"value[\s_-]?error",
    r"runtime[\s_-]?error",
)

# Alternatives of the short pattern used by on-demand reports.
REPORT_FIX_TERMS = (r"fix(es|ed|ing)?", r"bug(fix|s)?", r"defect", r"regression", r"crash")


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def fix_flag_loose(message: Column, words=FIX_WORDS, patterns=ISSUE_REFERENCES) -> Column:
    """Any keyword as a substring, or any issue reference."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return any_of([F.contains(text, F.lit(w)) for w in words] + [text.rlike(p) for p in patterns])


def fix_flag_terms(message: Column, terms) -> Column:
    """Case-insensitive whole-word match of any term."""
    return F.coalesce(message, F.lit("")).rlike(r"(?i)\b(" + "|".join(terms) + r")\b")


def fix_flag_strict(message: Column) -> Column:
    return fix_flag_terms(message, STRICT_FIX_TERMS)


def fix_flag_report(message: Column) -> Column:
    return fix_flag_terms(message, REPORT_FIX_TERMS)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_relative(path: Column) -> Column:
    """Forward slashes, without any leading dots and slashes."""
    return F.regexp_replace(forward_slashes(path), r"^[./]+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(forward_slashes(path), "/"), -1)


def repo_from_url(url: Column) -> Column:
    """Last URL segment without trailing slashes and without ``.git``."""
    trimmed = F.regexp_replace(url, r"/+$", "")
    return F.replace(F.element_at(F.split(trimmed, "/"), -1), F.lit(".git"), F.lit(""))


# Every character (or pair) that ends a line.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"


def line_count(text: Column) -> Column:
    """Number of lines; a trailing line end does not start another line."""
    ends = F.regexp_count(text, F.lit(LINE_END))
    # Only the last character is looked at: in the whole text, every place would be tried.
    open_tail = F.when(F.right(text, F.lit(1)).rlike(r"(?s)[^\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]\z"), 1).otherwise(0)
    return (ends + open_tail).cast("bigint")


def not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"\S")


def fixed(value: Column, places: int, sign: str = "") -> Column:
    """``value`` with ``places`` decimals as C prints it: the exact binary value rounded, a tie to the even digit.

    ``format_string`` rounds the shortest decimal form half up: 0.125 and 0.145 (a little
    less than that) would become 0.13 and 0.15, not 0.12 and 0.14.
    """
    steps = float(2 * 10**places)
    size = F.abs(value)
    halves = F.rint(size * steps)
    # Both products and their difference are exact, so the sign tells on which side of the tie the value lies.
    high = size.cast("float").cast("double")
    above = (high * steps - halves) + (size - high) * steps
    low = F.floor(halves / 2).cast("double")
    odd = F.pmod(low, F.lit(2.0)) == 1
    whole = F.when((halves / 2 != low) & ((above > 0) | ((above == 0) & odd)), low + 1).otherwise(low)
    near = whole / (steps / 2)
    rounded = F.when(size < 1e12, F.when(value < 0, -near).otherwise(near)).otherwise(value)
    return F.format_string(f"%{sign}.{places}f", rounded)

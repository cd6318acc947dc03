"""Row filters and coercions of untyped metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import squeeze, strip

#: Fixed values of the collection's metadata.
NO_TITLE, NO_SOURCE = "Untitled notice", "Chroma data"
#: A question about lecture reviews names one of the subjects and one of the signals.
REVIEW_CATEGORY = "강의평"
REVIEW_SUBJECTS = ("교수", "강의", "수업")
REVIEW_SIGNALS = ("강의평", "평가", "후기", "리뷰", "어때", "난이도", "시험")


def whole_number(x: Column) -> Column:
    """A number from text of digits, white space around them aside; null for anything else."""
    bare = strip(x)
    return F.when(bare.rlike("^[0-9]+$"), bare).try_cast("bigint")


def or_default(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def or_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def has_text(x: Column) -> Column:
    return F.coalesce(strip(x) != "", F.lit(False))


def has_web_address(x: Column) -> Column:
    bare = strip(x)
    return F.coalesce(bare.startswith("http://") | bare.startswith("https://"), F.lit(False))


def valid_question(x: Column) -> Column:
    """2 to 500 characters, of which 2 at least are left without white space at the ends."""
    return F.coalesce(F.length(x).between(2, 500) & (F.length(strip(x)) >= 2), F.lit(False))


def names_any(x: Column, values: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.contains(x, F.lit(v))
    return out


def explicit_category(question: Column, subjects: tuple[str, ...] = REVIEW_SUBJECTS, signals: tuple[str, ...] = REVIEW_SIGNALS, category: str = REVIEW_CATEGORY) -> Column:
    """The category that the question asks for by its words; null if none."""
    bare = squeeze(question)
    return F.when(names_any(bare, subjects) & names_any(bare, signals), F.lit(category))

"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Particles that end a Korean word, in the order in which they are tried.
PARTICLES = ("으로", "에서", "까지", "부터", "에게", "한테", "처럼", "보다", "로", "을", "를", "은", "는", "이", "가", "의", "와", "과", "도", "에")
#: How a text names a term, in the order in which they are tried.
TERMS = (("summer", r"여름\s*계절(?:학기|수업)?"), ("winter", r"겨울\s*계절(?:학기|수업)?"), ("first", r"1\s*학기"), ("second", r"2\s*학기"))
#: A word, and a year between other characters than digits.
TOKEN, YEAR = "[0-9a-z가-힣]+", r"(?<![0-9])((?:19|20)[0-9]{2})(?:학년도|년)?(?![0-9])"


def strip(x: Column) -> Column:
    """Without Unicode white space at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def fold_case(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalise(x: Column) -> Column:
    """Case folded, white space collapsed to single spaces."""
    return strip(F.regexp_replace(fold_case(x), r"(?U)\s+", " "))


def compact(x: Column) -> Column:
    """Case folded, only letters and digits."""
    return F.regexp_replace(fold_case(x), "[^0-9a-z가-힣]", "")


def words(x: Column) -> Column:
    """Case-folded runs of letters and digits."""
    return F.regexp_extract_all(fold_case(x), F.lit(TOKEN), F.lit(0))


def without_particle(x: Column) -> Column:
    """A word without the first particle of the list that it ends with, if two letters or more are left."""
    out = F
    for p in PARTICLES:
        out = out.when(x.endswith(p) & (F.length(x) > len(p) + 1), F.substring(x, F.lit(1), F.length(x) - len(p)))
    return out.otherwise(x)


def tokens(x: Column) -> Column:
    """Words without particles, of two letters at least."""
    return F.filter(F.transform(words(x), without_particle), lambda w: F.length(w) >= 2)


def year(x: Column) -> Column:
    found = F.regexp_extract(x, YEAR, 1)
    return F.when(found != "", found).cast("int")


def term(x: Column) -> Column:
    out = F
    for name, pattern in TERMS:
        out = out.when(x.rlike(pattern), name)
    return out


def bullets(x: Column) -> Column:
    """Every line as a bullet; blank lines and lines of bullet marks alone go."""
    lines = F.transform(F.split(x, r"\R"), strip)
    bare = lambda s: strip(F.regexp_replace(s, r"^[-*• ]+", ""))
    marked = F.transform(lines, lambda s: F.when(s.startswith("- "), s).when(bare(s) != "", F.concat(F.lit("- "), bare(s))))
    return F.array_join(F.filter(marked, lambda s: s.isNotNull()), "\n")


def char_grams(x: Column, least: int = 2, most: int = 4) -> Column:
    """All runs of `least` to `most` characters."""
    return F.concat(*[_runs(x, n) for n in range(least, most + 1)])


def _runs(x: Column, n: int) -> Column:
    """Runs of n characters, in linear time: the characters are taken apart once, bound by an array of one element."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(x) - n, F.lit(0)))
    runs = F.transform(F.array(F.split(x, "")), lambda c: F.transform(starts, lambda i: F.concat(*(F.get(c, i + k) for k in range(n)))))[0]
    return F.when(F.length(x) >= n, runs).otherwise(F.array().cast("array<string>"))


def published(x: Column) -> Column:
    """A time from ISO text (a date, maybe a time and an offset); null for any other text."""
    iso = x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$")
    return F.try_to_timestamp(F.when(iso, x))


def sentences(x: Column) -> Column:
    """Sentences and lines, trimmed, none empty."""
    parts = F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), strip)
    return F.filter(parts, lambda s: s != "")

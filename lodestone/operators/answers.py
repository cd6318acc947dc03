"""The default answer writer: whole sentences, chosen for what they say about the question and not about each other."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import TOKEN, fold_case, sentences

_WORDS = re.compile(TOKEN).findall


def choose(folded: list[str], terms: set[str], most: int, lengths: list[int], balance: float = 0.7) -> list[int]:
    """Numbers of the chosen sentences, in order: greedily the one of the greatest relevance (share of the question's words
    that it says) less its greatest likeness (Jaccard of words) to one chosen before, as long as `most` characters hold it.

    Sentences without one of the words are taken only where no sentence has any; then the first that fits is.
    """
    words = [set(_WORDS(s)) for s in folded]
    gain = [len(w & terms) / max(1, len(terms)) for w in words]
    some = [i for i, g in enumerate(gain) if g > 0 and lengths[i] <= most]
    if not some:
        return next(([i] for i, n in enumerate(lengths) if n <= most), [])
    like = [0.0] * len(folded)
    chosen: list[int] = []
    left = most
    while some:
        best = max(some, key=lambda i: (round(balance * gain[i] - (1 - balance) * like[i], 12), -i))
        if chosen and balance * gain[best] - (1 - balance) * like[best] <= 0:
            break
        chosen.append(best)
        left -= lengths[best] + 1
        some = [i for i in some if i != best and lengths[i] <= left]
        for i in some:
            both = len(words[i] & words[best])
            like[i] = max(like[i], both / max(1, len(words[i]) + len(words[best]) - both))
    return sorted(chosen)


def extractive(context: Column, terms: Column, most: int = 700) -> Column:
    """An answer of at most `most` characters from a context: its chosen sentences, a line each; null if none fits."""

    @F.pandas_udf("string")
    def write(lines: pd.Series, folded: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for line, fold, term in zip(lines, folded, asked):
            picked = choose(list(fold), set(term), most, [len(s) for s in line]) if line is not None and len(line) else []
            out.append("\n".join(line[i] for i in picked) or None)
        return pd.Series(out, dtype=object)

    parts = F.coalesce(sentences(context), F.array().cast("array<string>"))
    return write(parts, F.transform(parts, fold_case), F.coalesce(terms, F.array().cast("array<string>")))


def required(answer: Column) -> Column:
    """The answer; an empty one is an error, which ends the job."""
    return F.when(F.length(F.coalesce(answer, F.lit(""))) > 0, answer).otherwise(F.raise_error(F.lit("the answer is empty")))

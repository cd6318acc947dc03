"""Classification by very many phrases: one Aho-Corasick automaton, which walks a text once whatever its phrases are.

`classify.longest_match` makes a CASE of all phrases, which suits a catalog of a few hundred; here the time is linear in the
text. Both give the same keys.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import normalise
from lodestone.operators.classify import Catalog, Rule, _fold


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, int, str], ...]):
    """An automaton whose values order phrases: longer ones first, then the earlier rule. Built once for each worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, order, key in phrases:
        value = (-len(phrase), order, key)
        out.add_word(phrase, min(value, out.get(phrase, value)))
    out.make_automaton()
    return out


def best_key(text: str | None, phrases: tuple[tuple[str, int, str], ...]) -> str | None:
    found = min((value for _, value in _automaton(phrases).iter(text)), default=None) if text else None
    return found[2] if found else None


def longest_match(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Key of the rule with the longest phrase in the text (case and white space folded); of equals the first rule."""
    phrases = tuple((_fold(k), n, r.key) for n, r in enumerate(rules) for k in r.keywords if _fold(k))
    if not phrases:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def key(folded: pd.Series) -> pd.Series:
        return pd.Series([best_key(t, phrases) for t in folded], dtype=object)

    return key(normalise(text))


def topic(text: Column, catalog: Catalog, override: Column | None = None) -> Column:
    """As `classify.topic`: a known override, else the longest match, else the default."""
    found = F.coalesce(longest_match(text, catalog.rules), F.lit(catalog.default))
    return found if override is None else F.when(override.isin(*[r.key for r in catalog.rules]), override).otherwise(found)

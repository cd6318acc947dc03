"""Unicode normalisation, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility characters in their plain form: full width letters, ligatures, composed syllables; null stays null."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in text], dtype=object)

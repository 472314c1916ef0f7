"""Unicode normalisation as an Arrow-batched function; no built-in function has it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf

_SPACE = re.compile(r"\s+")


@pandas_udf("string")
def nfkc_collapse(text: pd.Series) -> pd.Series:
    """NFKC, then runs of white space as single spaces, trimmed; null stays null."""
    return text.map(lambda t: _SPACE.sub(" ", unicodedata.normalize("NFKC", t)).strip(), na_action="ignore")

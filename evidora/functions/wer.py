"""Word errors as a vectorised function."""

import pandas as pd
from pyspark.sql import functions as F

from evidora import config as C
from evidora.functions.numbers import word_errors


def errors_udf():
    """(said, heard) -> [errors, content words not heard]."""
    stop = frozenset(C.STOPWORDS)

    @F.pandas_udf("array<long>")
    def errors(said: pd.Series, heard: pd.Series) -> pd.Series:
        found = [(list(a), *word_errors(list(a), list(b))) for a, b in zip(said, heard, strict=True)]
        return pd.Series([[n, sum(a[k] not in stop for k in wrong)] for a, n, wrong in found])

    return errors

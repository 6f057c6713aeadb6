"""Edit measures that no built-in expresses, on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Rows of neighbouring keys.
KEY_ROWS = ["йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890"]
NEIGHBOURS = {(a, b) for row in KEY_ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}


def weighted(a: str, b: str, near: float = 0.5) -> float:
    """Edits between two words, where replacing a key by its neighbour costs ``near``."""
    a, b = a.lower().replace("ё", "е"), b.lower().replace("ё", "е")
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            swap = diagonal + (0.0 if x == y else near if (x, y) in NEIGHBOURS else 1.0)
            diagonal, row[j] = row[j], min(row[j] + 1.0, row[j - 1] + 1.0, swap)
    return row[-1]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(DoubleType())
def weighted_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted edit distance; null with a null."""
    return pd.Series([None if x is None or y is None else weighted(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - weighted distance / longer length; 0 for an empty word."""
    return pd.Series([None if x is None or y is None else 0.0 if not x or not y else 1.0 - weighted(x, y) / max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * longest common subsequence / both lengths; 100 for two empty words."""
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * common_subsequence(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

"""Perceptual hash of grey values; pictures are decoded elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_basis(side: int, rows: int) -> np.ndarray:
    """The first ``rows`` cosines of the unscaled DCT-II over ``side`` places."""
    return 2 * np.cos(np.pi / side * (np.arange(side)[None, :] + 0.5) * np.arange(rows)[:, None])


def dct_hash(grey: str | Column, side: int = 32, low: int = 8) -> Column:
    """A 64-bit number: the signs of the ``low`` x ``low`` slowest waves of a picture of ``side`` x ``side`` grey values (an array by rows) against their median.

    The first wave is the highest bit. Null for an array of another length, or with a null or non-finite value.
    """
    basis = cosine_basis(side, low)

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            x = np.asarray([np.nan if y is None else y for y in x], float) if x is not None else np.zeros(0)
            if len(x) != side * side or not np.isfinite(x).all():
                out.append(None)
                continue
            waves = (basis @ x.reshape(side, side) @ basis.T).ravel()
            bits = 0
            for b in waves > np.median(waves):
                bits = bits << 1 | int(b)
            out.append(bits - (1 << 64) if bits >> 63 else bits)
        return pd.Series(out, dtype="Int64")

    return run(F.col(grey) if isinstance(grey, str) else grey)

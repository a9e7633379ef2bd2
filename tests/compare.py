"""Rows of two pandas frames as comparable sorted lists."""

import numpy as np
import pandas as pd


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        return float(v) if isinstance(v, int | float | np.integer | np.floating) else str(v)

    out = [tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))

"""Comparison of result tables without regard to the order of rows."""

import math

import numpy as np


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    for x, y in zip(rows(a), rows(b), strict=True):
        for p, q in zip(x, y, strict=True):
            if isinstance(p, float) and isinstance(q, float):
                assert math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-5), (x, y)
            else:
                assert p == q or str(p) == str(q), (x, y)

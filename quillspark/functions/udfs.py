"""Vectorised functions for what Catalyst lacks: Unicode normal forms and exact polygon geometry."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """O-104."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding, as O-105 matches unseen spellings."""
    return s.map(lambda x: None if x is None else x.casefold())


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of one polygon within a convex one, cut along one edge after another."""
    window = window if _area(window) > 0 else window[::-1]
    out = subject if _area(subject) > 0 else subject[::-1]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0):
                kept.append(out[i] + (out[j] - out[i]) * side[i] / (side[i] - side[j]))
        out = np.array(kept).reshape(-1, 2)
    return out


def convex_iou(a, b) -> float:  # noqa: ANN001
    """O-136: intersection over union of convex polygons; 0 for anything malformed."""
    try:
        p, q = (np.array([list(map(float, x)) for x in poly]) for poly in (a, b))
        if len(p) < 3 or len(q) < 3 or not (np.isfinite(p).all() and np.isfinite(q).all()):
            return 0.0
    except (TypeError, ValueError):
        return 0.0
    both = clip_convex(p, q)
    common = abs(_area(both)) if len(both) >= 3 else 0.0
    union = abs(_area(p)) + abs(_area(q)) - common
    return common / union if union > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def polygon_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([convex_iou(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """O-138: hull in counter-clockwise order, by sorted sweeps."""
    pts = sorted(set(map(tuple, np.asarray(points, dtype=float))))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def sweep(seq: list) -> list:
        hull: list = []
        for p in seq:
            while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
                hull.pop()
            hull.append(p)
        return hull[:-1]

    return np.array(sweep(pts) + sweep(pts[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """O-138: the rectangle of least area around the points; one side lies on a hull edge."""
    hull = convex_hull(points)
    if len(hull) < 3:
        raise ValueError("three points that aren't on a line are needed")
    best = None
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        u = (b - a) / np.hypot(*(b - a))
        v = np.array([-u[1], u[0]])
        s, t = hull @ u, hull @ v
        area = np.ptp(s) * np.ptp(t)
        if best is None or area < best[0] - 1e-12:
            best = area, np.array([u * x + v * y for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return best[1]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def minimum_area_quad(points: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or len(p) < 3 else [[float(v) for v in q] for q in least_rectangle(np.array([list(x) for x in p]))] for p in points])

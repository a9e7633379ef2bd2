"""Fitted profiles along a line: shapes and modules."""

from __future__ import annotations

import numpy as np

from matriq.functions.cluster import correlate, cut, linkage

#: The part of a profile's ups and downs that a shape must account for.
SHARE = 0.8


def unit(profiles: np.ndarray) -> np.ndarray:
    """Each row from 0 to 1; a flat row is 0."""
    p = np.asarray(profiles, float)
    span = np.ptp(p, axis=1, keepdims=True)
    return np.where(span > 0, (p - p.min(1, keepdims=True)) / np.where(span > 0, span, 1), 0.0)


def shapes(profiles: np.ndarray) -> list[str]:
    """increasing, decreasing, peak, trough or complex, by how much of all ups and downs each shape accounts for.

    Of the summed steps, a rising profile's are up; a peak's are one climb to its top and one fall from it, a trough's the
    reverse. The first that accounts for SHARE of the sum names the profile; flat profiles are complex.
    """
    out = []
    for p in np.asarray(profiles, float):
        step = np.diff(p)
        ways = np.abs(step).sum()
        up = step[step > 0].sum()
        one_top, one_low = 2 * p.max() - p[0] - p[-1], p[0] + p[-1] - 2 * p.min()
        parts = {"increasing": up, "decreasing": ways - up, "peak": one_top, "trough": one_low}
        out.append(next((name for name, part in parts.items() if ways > 0 and part >= SHARE * ways), "complex"))
    return out


def modules(profiles: np.ndarray, height: float = 0.5) -> np.ndarray:
    """Modules of like profiles (average linkage of 1 - r, cut at a height), numbered by where their mean peaks."""
    p = unit(profiles)
    if len(p) < 2:
        return np.zeros(len(p), int)
    d = np.maximum(1 - correlate(p), 0)
    label = cut(linkage(d), len(p), height=height)
    peaks = [p[label == c].mean(0).argmax() for c in range(label.max() + 1)]
    return np.argsort(np.argsort(peaks, kind="stable"))[label]

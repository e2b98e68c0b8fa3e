"""Smoothing and derivatives along the bands of a spectrum, as array expressions: least-squares convolution (Savitzky-Golay)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def kernels(n: int, window: int, degree: int, derivative: int = 0, step: float = 1.0) -> list[tuple[int, list[float]]]:
    """For each of ``n`` evenly spaced places the first place that it sees, and the weights from there on.

    A place sees the ``window`` places around it and takes the value, or the derivative, of the polynomial of ``degree`` that fits
    them best. Near the ends it sees the first or last ``window`` places, and takes the polynomial's value off its middle.
    """
    if window % 2 == 0 or not 0 <= derivative <= degree < window:
        raise ValueError(f"no fit of degree {degree} and derivative {derivative} to {window} values")
    if n < window:
        raise ValueError(f"{n} values are fewer than a window of {window}")
    out = []
    for i in range(n):
        first = min(max(0, i - window // 2), n - window)
        powers = np.vander(np.arange(window) - (i - first), degree + 1, increasing=True)
        weights = np.linalg.pinv(powers)[derivative] * math.factorial(derivative) / step**derivative
        out.append((first, weights.tolist()))
    return out


def smoothed(array: Column, segments: list[tuple[int, int]], window: int, degree: int, derivative: int = 0, step: float = 1.0) -> Column:
    """An array of the same length with each segment (first band, one past the last) smoothed by itself, for gaps such as those at
    water windows: bands outside all segments, and in segments shorter than the window, are null.

    A band is null where one that it sees is null. ``step`` is the distance of two bands, in the unit that derivatives are by.
    """
    ends = max((end for _, end in segments), default=0)
    seen: list[tuple[int, list[float]] | None] = [None] * ends
    for first, end in segments:
        if end - first >= window:
            seen[first:end] = [(first + at, w) for at, w in kernels(end - first, window, degree, derivative, step)]
    weights = F.array(*[F.struct(F.lit(k[0] if k else None).cast("int").alias("first"), F.lit(k[1] if k else []).cast("array<double>").alias("w")) for k in seen])

    def one(k: Column) -> Column:
        products = F.zip_with(F.slice(array, k["first"] + 1, F.size(k["w"])), k["w"], lambda v, w: v * w)
        whole = k["first"].isNotNull() & (k["first"] + F.size(k["w"]) <= F.size(array))
        return F.when(whole, F.aggregate(products, F.lit(0.0), lambda a, p: a + p))

    return F.transform(array, lambda _, i: F.when(i < ends, one(F.try_element_at(weights, i + 1))))

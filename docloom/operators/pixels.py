"""Pixel figures of page images, by numpy over Arrow batches.

Images come as rows with their bytes and size: grey or RGB values, row by row. A decoder for file
formats is a plug-in (``decode``), since none is part of the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Decode = Callable[[bytes, int, int], np.ndarray]


def raw_grey(data: bytes, width: int, height: int) -> np.ndarray:
    """Plain grey bytes as an array of rows."""
    return np.frombuffer(data, np.uint8)[: width * height].reshape(height, width).astype(np.float64)


def crop(image: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """The part of an image in shares of its sides, kept inside and at least one pixel."""
    h, w = image.shape[:2]
    left, top = min(w - 1, max(0, int(x1 * w))), min(h - 1, max(0, int(y1 * h)))
    return image[top : max(top + 1, min(h, int(y2 * h))), left : max(left + 1, min(w, int(x2 * w)))]


def quality(grey: np.ndarray) -> dict[str, float]:
    """Clarity, contrast, noise and their mean, each from 0 to 1."""
    padded = np.pad(grey, 1, mode="edge")
    laplace = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * grey
    clarity, contrast = min(1.0, laplace.var() / 1000), min(1.0, grey.std() / 255)
    steps = [np.abs(np.diff(grey, axis=a)).mean() for a in (0, 1) if grey.shape[a] > 1]
    noise = min(1.0, (sum(steps) / len(steps) if steps else 0.0) / 50)
    density, edges = float((grey < 128).mean()), float((np.abs(laplace) > 30).mean())
    return {"clarity": float(clarity), "contrast": float(contrast), "noise": float(noise), "text_density": density, "edge_density": edges, "overall": float((clarity + contrast + (1 - noise)) / 3)}


def embedding(grey: np.ndarray, size: int = 512) -> list[float]:
    """Mean, deviation, percentiles and texture of an image, filled with zeros."""
    dx, dy = (np.abs(np.diff(grey, axis=a)) if grey.shape[a] > 1 else np.zeros(1) for a in (1, 0))
    values = [grey.mean(), grey.std(), *np.percentile(grey, [10, 25, 50, 75, 90]), dx.mean(), dx.std(), dy.mean(), dy.std()]
    return ([float(v) / 255 for v in values] + [0.0] * size)[:size]


def line_runs(grey: np.ndarray, share: float = 0.1, least: int = 10) -> list[tuple[int, int]]:
    """Runs of rows with ink, at least ``least`` rows high: (first, row after the last)."""
    ink = (255 - grey).sum(axis=1)
    on = ink > share * ink.max() if ink.max() > 0 else np.zeros(len(ink), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def page_features(grey: np.ndarray) -> dict[str, float]:
    """Blur, illumination, margins, balance and the estimated columns of a page."""
    q, ink = quality(grey), 255 - grey
    columns, rows = ink.mean(axis=0), ink.mean(axis=1)
    used_x, used_y = np.flatnonzero(columns > columns.max() * 0.05), np.flatnonzero(rows > rows.max() * 0.05)
    half = grey.shape[1] // 2
    left, right = float(ink[:, :half].sum()), float(ink[:, half:].sum())
    gaps = np.flatnonzero(np.diff(np.concatenate([[0], (columns > columns.max() * 0.05).astype(np.int8), [0]])))
    return {
        "blur": 1 - q["clarity"],
        "illumination": float(grey.mean() / 255),
        "unevenness": float(np.abs(grey[: len(grey) // 2].mean() - grey[len(grey) // 2 :].mean()) / 255) if len(grey) > 1 else 0.0,
        "margin_left": float(used_x[0] / grey.shape[1]) if len(used_x) else 0.0,
        "margin_top": float(used_y[0] / grey.shape[0]) if len(used_y) else 0.0,
        "balance": 1 - abs(left - right) / (left + right) if left + right else 1.0,
        "columns": float(len(gaps) // 2),
        "complexity": (q["edge_density"] + q["text_density"]) / 2,
    }


def image_figures(images: DataFrame, decode: Decode = raw_grey) -> DataFrame:
    """Per image (image_id, data, width, height): its quality figures, line runs and an embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                grey = decode(bytes(r.data), r.width, r.height)
                q = quality(grey)
                rows.append((r.image_id, q["clarity"], q["contrast"], q["noise"], q["overall"], len(line_runs(grey)), embedding(grey)))
            yield pd.DataFrame(rows, columns=["image_id", "clarity", "contrast", "noise", "overall", "lines", "embedding"])

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "data", "width", "height").mapInPandas(run, f"image_id {kind}, clarity double, contrast double, noise double, overall double, lines long, embedding array<double>")

"""Pixel kernels of the quality record, in NumPy; images are H x W x 3 arrays (R, G, B), boxes lists of four points."""

from __future__ import annotations

import numpy as np
import pandas as pd

from loomgrain.runtime import pandas_map

CENTRE = (0.15, 0.85)
BORDER = 0.05


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def mask(boxes: list, h: int, w: int) -> np.ndarray:
    """The union of the filled quadrilaterals (convex), edges included."""
    out = np.zeros((h, w), bool)
    for b in boxes:
        p = np.asarray(b, float)
        if p.shape != (4, 2):
            continue
        x0, y0 = np.maximum(np.floor(p.min(0)).astype(int), 0)
        x1, y1 = np.minimum(np.ceil(p.max(0)).astype(int), [w - 1, h - 1])
        if x1 < x0 or y1 < y0:
            continue
        x, y = np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1))
        q = np.roll(p, -1, 0)
        cross = [(e[0] - s[0]) * (y - s[1]) - (e[1] - s[1]) * (x - s[0]) for s, e in zip(p, q)]
        inside = np.all([c >= 0 for c in cross], 0) | np.all([c <= 0 for c in cross], 0)
        out[y0 : y1 + 1, x0 : x1 + 1] |= inside
    return out


def coverage(text: np.ndarray, legacy_scale: bool = True) -> float:
    """M3: share of text pixels; the shipped thresholds expect it times 255."""
    return float(text.mean() * (255 if legacy_scale else 1)) if text.size else 0.0


def sharpness(rgb: np.ndarray) -> float:
    """M4: variance of the Laplacian, borders reflected."""
    g = np.pad(grey(rgb), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def contrast(rgb: np.ndarray) -> float:
    """M5: deviation of the brightest channel."""
    return float((rgb.max(-1) / 255.0).std())


def edges(rgb: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny edges: Sobel gradients, thinning along the gradient, and hysteresis."""
    g = np.pad(grey(rgb), 1, mode="edge")
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    turn = (np.rad2deg(np.arctan2(gy, gx)) + 180) % 180
    s = np.pad(size, 1)
    step = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    sector = ((turn + 22.5) // 45).astype(int) % 4
    thin = np.zeros(size.shape, bool)
    h, w = size.shape
    for k, (dy, dx) in step.items():
        ahead, behind = s[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], s[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        thin |= (sector == k) & (size >= ahead) & (size > behind)
    weak, out = thin & (size > low), thin & (size > high)
    while True:
        p = np.pad(out, 1)
        grown = weak & np.any([p[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y in (-1, 0, 1) for x in (-1, 0, 1)], 0)
        if (grown == out).all():
            return out
        out = grown


def clutter(rgb: np.ndarray, text: np.ndarray) -> float:
    """M6: edge pixels outside the text per pixel."""
    return float((edges(rgb) & ~text).mean())


def centrality(text: np.ndarray) -> float:
    """M7: share of the text pixels in the middle of the image; 0 without text."""
    h, w = text.shape
    mid = text[int(h * CENTRE[0]) : int(h * CENTRE[1]), int(w * CENTRE[0]) : int(w * CENTRE[1])]
    return float(mid.sum() / text.sum()) if text.any() else 0.0


def border_ratio(text: np.ndarray) -> float:
    """M8: share of the text pixels in the frame of 5 % of the shorter side; 0 without text."""
    m = int(min(text.shape) * BORDER)
    if not text.any():
        return 0.0
    inner = text[m : text.shape[0] - m, m : text.shape[1] - m]
    return float((text.sum() - inner.sum()) / text.sum())


def scores(rgb: np.ndarray, boxes: list, legacy_scale: bool = True) -> dict[str, float]:
    """M9: the pixel metrics of one image."""
    text = mask(boxes or [], *rgb.shape[:2])
    return {
        "coverage": coverage(text, legacy_scale), "sharpness": sharpness(rgb), "contrast": contrast(rgb),
        "clutter_index": clutter(rgb, text), "centrality": centrality(text), "border_ratio": border_ratio(text),
    }


SCORES = "coverage double, sharpness double, contrast double, clutter_index double, centrality double, border_ratio double"


def scored(images, key: str = "path"):
    """Adds the pixel metrics to a table of ``key``, image (Spark's image struct) and boxes; undecodable images have nulls."""

    def run(batches):
        names = [c.split()[0] for c in SCORES.split(", ")]
        for t in batches:
            out = []
            for image, boxes in zip(t["image"], t["boxes"]):
                h, w, c = image["height"], image["width"], image["nChannels"]
                if h is None or h <= 0 or c < 3:
                    out.append(dict.fromkeys(names))
                    continue
                rgb = np.frombuffer(image["data"], np.uint8).reshape(h, w, c)[..., 2::-1]
                out.append(scores(rgb, [[list(p) for p in b] for b in boxes] if boxes is not None else []))
            yield pd.concat([t[[key]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kind = images.schema[key].dataType.simpleString()
    return pandas_map(images.select(key, "image", "boxes"), run, f"{key} {kind}, {SCORES}")

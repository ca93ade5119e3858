"""Frame-form kernels: numpy over batches of equal frames, without any shuffle.

Arrays are (frames, height, width).  Each kernel returns the result and, for each frame, whether
it is defined there; where it isn't, the executor keeps the frame (or takes an empty mask).
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from stackloom.operators.filters import gaussian_weights, gram

Result = tuple[np.ndarray, np.ndarray]


def _all(d: np.ndarray) -> np.ndarray:
    return np.ones(len(d), bool)


def row_median(d: np.ndarray, mask: np.ndarray | None = None) -> Result:
    if mask is None:
        return d - np.median(d, 2, keepdims=True), _all(d)
    n = (~mask).sum(2)
    low = np.sort(np.where(mask, np.inf, d), 2)  # NaN comes last, after what is masked
    pick = lambda k: np.take_along_axis(low, np.clip(k, 0, d.shape[2] - 1)[:, :, None], 2)[:, :, 0]
    with np.errstate(invalid="ignore"):
        mid = np.where(n % 2 == 1, pick((n - 1) // 2), (pick(n // 2 - 1) + pick(n // 2)) / 2)
    mid = np.where((np.isnan(d) & ~mask).any(2), np.nan, np.where(n == 0, 0.0, mid))
    return d - mid[:, :, None], _all(d)


def centre(d: np.ndarray, mask: np.ndarray | None = None) -> Result:
    if mask is None:
        return d - d.mean((1, 2), keepdims=True), _all(d)
    n = (~mask).sum((1, 2))
    mean = np.where(mask, 0.0, d).sum((1, 2)) / np.maximum(n, 1)
    return d - mean[:, None, None], n > 0


def _basis(height: int, width: int, order: int) -> np.ndarray:
    axis = lambda n: np.array([np.polynomial.polynomial.polyval((np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 1), c) for c in gram(n, order)])
    px, py = axis(width), axis(height)
    return np.array([np.outer(py[j], px[i]).ravel() for s in range(order + 1) for i in range(s, -1, -1) for j in [s - i] if i < len(px) and j < len(py)])


def _detrend(d: np.ndarray, mask: np.ndarray | None, order: int, least: int) -> Result:
    b = _basis(*d.shape[1:], order)
    flat = d.reshape(len(d), -1)
    if mask is None:
        return (flat - (flat @ b.T) @ b).reshape(d.shape), np.isfinite(flat).all(1)
    w = (~mask).reshape(len(d), -1)
    used = np.where(w, flat, 0.0)
    finite = np.isfinite(used).all(1)
    used = np.where(finite[:, None], used, 0.0)
    normal = np.einsum("kp,np,lp->nkl", b, w.astype(float), b, optimize=True)
    c = np.einsum("nkl,nl->nk", np.linalg.pinv(normal, 1e-10, hermitian=True), used @ b.T)
    out = (flat - c @ b).reshape(d.shape)
    out[~finite] = np.nan
    return out, w.sum(1) >= least


def plane(d: np.ndarray, mask: np.ndarray | None = None) -> Result:
    out, ok = _detrend(d, mask, 1, 3)
    inside = np.isfinite(d) if mask is None else np.isfinite(d) | mask
    return out, ok & inside.all((1, 2))


def polynomial(d: np.ndarray, mask: np.ndarray | None = None, order: int = 2) -> Result:
    if not isinstance(order, int) or isinstance(order, bool) or order < 1:
        return d, ~_all(d)
    out, ok = _detrend(d, mask, order, (order + 1) * (order + 2) // 2)
    if mask is None:
        out[~ok] = np.nan
        ok = _all(d)
    return out, ok


def smooth(d: np.ndarray, sigma: float = 1.0) -> Result:
    if sigma <= 0:
        return d, _all(d)
    w = gaussian_weights(sigma)
    r = len(w) // 2
    for axis in (2, 1):
        wide = np.pad(d, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        n = d.shape[axis]
        d = sum(w[k] * np.take(wide, np.arange(k, k + n), axis) for k in range(len(w)))
    return d, _all(d)


def threshold_above(d: np.ndarray, threshold: float = 0.0) -> Result:
    return (d > threshold) & np.isfinite(d), _all(d)


def threshold_below(d: np.ndarray, threshold: float = 0.0) -> Result:
    return (d < threshold) & np.isfinite(d), _all(d)


def above_mean(d: np.ndarray, factor: float = 1.0) -> Result:
    with np.errstate(invalid="ignore"):
        return d - d.mean((1, 2), keepdims=True) > factor * d.std((1, 2), keepdims=True), _all(d)


def above_tile_mean(d: np.ndarray, block_size: int = 15, offset: float = 0.0) -> Result:
    b = int(block_size)
    ys, xs = np.arange(0, d.shape[1], b), np.arange(0, d.shape[2], b)
    total = np.add.reduceat(np.add.reduceat(d, ys, 1), xs, 2)
    many = np.diff(np.append(ys, d.shape[1]))[:, None] * np.diff(np.append(xs, d.shape[2]))[None]
    mean = np.repeat(np.repeat(total / many, b, 1)[:, : d.shape[1]], b, 2)[:, :, : d.shape[2]]
    return d > mean + offset, _all(d)


def closed_magnitude(d: np.ndarray, threshold: float, structure_size: int = 3) -> Result:
    s = int(structure_size)
    back, ahead = s // 2, (s - 1) // 2
    with np.errstate(invalid="ignore"):
        m = np.abs(d) > threshold
    for before, after, take in ((ahead, back, np.max), (back, ahead, np.min)):
        for axis in (2, 1):
            wide = np.pad(m, [(before, after) if a == axis else (0, 0) for a in range(3)])
            m = take(sliding_window_view(wide, s, axis), -1)
    return m, _all(d)

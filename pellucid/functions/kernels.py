"""Numpy kernels over stacks of gray planes of one shape: arrays of (image, row, column).

They follow the public documentation of the usual image libraries (names of parameters and orders of
features included) and compute in double precision.
"""

from __future__ import annotations

import numpy as np

#: What is added to divisors, limits of the frequency bands, and the seed and number of sampled cosine blocks.
EPS = 1e-8
BANDS = ((0.0, 0.15), (0.15, 0.35), (0.35, 1.0))
SEED, BLOCKS = 42, 512


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of (..., 3) RGB, in integer arithmetic."""
    c = rgb.astype(np.int64)
    return (c[..., 0] * 19595 + c[..., 1] * 38470 + c[..., 2] * 7471 + 32768) >> 16


def laplacian_variance(g: np.ndarray) -> np.ndarray:
    p = np.pad(g.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="reflect") if min(g.shape[1:]) > 1 else np.pad(g.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    out = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]
    return out.var(axis=(1, 2))


def lbp_codes(img: np.ndarray, points: int, radius: int) -> np.ndarray:
    """The uniform local binary pattern of every pixel of planes that have a border of radius + 1: bilinear samples on a circle."""
    o = radius + 1
    n, h, w = img.shape[0], img.shape[1] - 2 * o, img.shape[2] - 2 * o
    g = img[:, o : o + h, o : o + w]
    angle = 2 * np.pi * np.arange(points) / points
    rows, cols = np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5)
    bits = np.empty((points, n, h, w), bool)
    for p in range(points):
        r0, c0 = int(np.floor(rows[p])), int(np.floor(cols[p]))
        r1, c1 = int(np.ceil(rows[p])), int(np.ceil(cols[p]))
        dr, dc = rows[p] - r0, cols[p] - c0

        def at(r: int, c: int) -> np.ndarray:
            return img[:, o + r : o + r + h, o + c : o + c + w]

        top = (1 - dc) * at(r0, c0) + dc * at(r0, c1)
        low = (1 - dc) * at(r1, c0) + dc * at(r1, c1)
        bits[p] = (1 - dr) * top + dr * low - g >= 0
    changes = (bits[1:] != bits[:-1]).sum(0)
    return np.where(changes <= 2, bits.sum(0), points + 1)


def lbp_histogram(g: np.ndarray, points: int = 24, radius: int = 3) -> np.ndarray:
    """Shares of uniform local binary patterns, zero outside the plane; points + 2 bins."""
    o = radius + 1
    code = lbp_codes(np.pad(g.astype(np.float64), ((0, 0), (o, o), (o, o))), points, radius).reshape(len(g), -1)
    hist = np.stack([np.bincount(c, minlength=points + 2) for c in code]).astype(float)
    return hist / (hist.sum(1, keepdims=True) + EPS)


def glcm_offsets(distances=(1, 2, 3), degrees=(0, 45, 90, 135)) -> list[tuple[int, int]]:
    return [(round(np.sin(np.deg2rad(a)) * d), round(np.cos(np.deg2rad(a)) * d)) for d in distances for a in degrees]


def glcm_features(g: np.ndarray, levels: int = 64) -> np.ndarray:
    """Contrast, dissimilarity, homogeneity and energy of symmetric co-occurrence matrices, each by distance and angle."""
    n, h, w = g.shape
    q = np.clip((g / 255.0 * (levels - 1)).astype(np.int64), 0, levels - 1)
    out = np.zeros((4, n, 12))
    for k, (dr, dc) in enumerate(glcm_offsets()):
        rows, cols = h - dr, w - abs(dc)
        if rows <= 0 or cols <= 0:
            continue
        a = q[:, :rows, max(0, -dc) : max(0, -dc) + cols].reshape(n, -1)
        b = q[:, dr:, max(0, dc) : max(0, dc) + cols].reshape(n, -1)
        d = np.abs(a - b)
        out[0, :, k], out[1, :, k], out[2, :, k] = (d * d).mean(1), d.mean(1), (1 / (1.0 + d * d)).mean(1)
        for i in range(n):
            c = np.bincount(np.concatenate([a[i] * levels + b[i], b[i] * levels + a[i]]))
            out[3, i, k] = np.sqrt(((c / c.sum()) ** 2).sum())
    return np.concatenate(list(out), axis=1)


def sobel(g: np.ndarray, border: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    mode = border if min(g.shape[1:]) > 1 else "edge"
    p = np.pad(g.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode=mode)
    smooth = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    across = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    return smooth[:, :, 2:] - smooth[:, :, :-2], across[:, 2:] - across[:, :-2]


def thinned(m: np.ndarray, dx: np.ndarray, dy: np.ndarray, low: float) -> np.ndarray:
    """Pixels above ``low`` that are no less than those across the edge; m: magnitudes, with a border of one."""
    h, w = dx.shape[1:]

    def at(r: int, c: int) -> np.ndarray:
        return m[:, 1 + r : 1 + r + h, 1 + c : 1 + c + w]

    mag = at(0, 0)
    x, y = np.abs(dx), np.abs(dy)
    flat, steep = y < x * 0.41421356237, y > x * 2.41421356237
    rising = (dx < 0) == (dy < 0)
    across = (mag > at(0, -1)) & (mag >= at(0, 1))
    down = (mag > at(-1, 0)) & (mag >= at(1, 0))
    diag = np.where(rising, (mag > at(-1, -1)) & (mag > at(1, 1)), (mag > at(-1, 1)) & (mag > at(1, -1)))
    return (mag > low) & np.where(flat, across, np.where(steep, down, diag))


def canny(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge masks: gradient sums of absolute values, thinning in four directions, hysteresis over eight neighbours."""
    dx, dy = sobel(g, "edge")
    mag = np.abs(dx) + np.abs(dy)
    thin = thinned(np.pad(mag, ((0, 0), (1, 1), (1, 1))), dx, dy, low)
    edge = thin & (mag > high)
    while True:
        p = np.pad(edge, ((0, 0), (1, 1), (1, 1)))
        near = np.zeros_like(edge)
        for r in range(3):
            for c in range(3):
                near |= p[:, r : r + g.shape[1], c : c + g.shape[2]]
        grown = edge | (thin & near)
        if (grown == edge).all():
            return edge
        edge = grown


def direction_histogram(dx: np.ndarray, dy: np.ndarray, mask: np.ndarray, bins: int = 8) -> np.ndarray:
    out = np.zeros((len(dx), bins))
    for i in range(len(dx)):
        if mask[i].any():
            hist = np.histogram(np.arctan2(dy[i][mask[i]], dx[i][mask[i]]), bins=bins, range=(-np.pi, np.pi))[0].astype(float)
            out[i] = hist / (hist.sum() + EPS)
    return out


def edge_features(g: np.ndarray) -> np.ndarray:
    """Share of edge pixels and the histogram of gradient directions there."""
    edge = canny(g)
    dx, dy = sobel(g)
    return np.concatenate([edge.mean(axis=(1, 2))[:, None], direction_histogram(dx, dy, edge)], axis=1)


def fft_features(g: np.ndarray, bins: int = 16) -> np.ndarray:
    """Mean, deviation and median of the log power; three band shares; mean power by radius."""
    n, h, w = g.shape
    power = np.abs(np.fft.fftshift(np.fft.fft2(g.astype(np.float64)), axes=(1, 2))) ** 2
    total = power.sum(axis=(1, 2)) + EPS
    y, x = np.ogrid[:h, :w]
    radius = np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2)
    top = float(max(1, min(h // 2, w // 2)))
    bands = [power[:, (radius >= lo * top) & (radius < hi * top)].sum(1) / total for lo, hi in BANDS]
    rings = []
    for i in range(bins):
        mask = (radius >= i / bins * top) & (radius < (i + 1) / bins * top)
        rings.append(power[:, mask].mean(1) if mask.any() else np.zeros(n))
    log = np.log(power + EPS).reshape(n, -1)
    return np.stack([log.mean(1), log.std(1), np.median(log, axis=1), *bands, *rings], axis=1)


def dct_matrix(size: int) -> np.ndarray:
    k, i = np.mgrid[:size, :size]
    c = np.sqrt(2 / size) * np.cos(np.pi * (2 * i + 1) * k / (2 * size))
    c[0] /= np.sqrt(2)
    return c


def dct_features(g: np.ndarray, block: int = 8, most: int = BLOCKS) -> np.ndarray:
    """Nine statistics of the orthonormal cosine coefficients of blocks; larger images give a fixed sample of blocks."""
    n, h, w = g.shape
    pad = ((0, 0), (0, (block - h % block) % block), (0, (block - w % block) % block))
    p = np.pad(g.astype(np.float64), pad, mode="reflect" if min(h, w) > 1 else "edge")
    rows, cols = p.shape[1] // block, p.shape[2] // block
    blocks = p.reshape(n, rows, block, cols, block).transpose(0, 1, 3, 2, 4).reshape(n, rows * cols, block, block)
    if rows * cols > most:
        blocks = blocks[:, np.random.default_rng(SEED).choice(rows * cols, size=most, replace=False)]
    c = dct_matrix(block)
    coef = (c @ blocks @ c.T).reshape(n, -1, block * block)
    size, flat = np.abs(coef), coef.reshape(n, -1)
    split = min(10, block * block)
    low, high = size[:, :, 1:split], size[:, :, split:]
    total = (flat**2).sum(1) + EPS

    def mean(a: np.ndarray) -> np.ndarray:
        return a.mean(axis=(1, 2)) if a.size else np.zeros(n)

    return np.stack([flat.mean(1), flat.std(1), np.median(flat, axis=1), (np.abs(flat) < 1e-6).mean(1), size[:, :, 0].mean(1), mean(low), mean(high), (low**2).sum(axis=(1, 2)) / total, (high**2).sum(axis=(1, 2)) / total], axis=1)


#: The low-pass decomposition filter of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])

HIGH = DB4[::-1] * np.where(np.arange(8) % 2, 1.0, -1.0)


def wavelet_levels(height: int, width: int, levels: int) -> int:
    """The levels that a plane has room for; one at least."""
    side = min(height, width)
    return max(1, min(levels, int(np.floor(np.log2(side / (len(DB4) - 1)))) if side >= len(DB4) - 1 else 0))


def analyse(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filters the last axis with symmetric borders and keeps every second value."""
    n = len(taps) - 1
    p = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(n, n)], mode="symmetric")
    view = np.lib.stride_tricks.sliding_window_view(p, len(taps), axis=-1)
    return (view @ taps[::-1])[..., 1::2]


def wavelet_features(g: np.ndarray, levels: int = 3) -> np.ndarray:
    """Mean, deviation and energy of every subband, then mean and deviation of the energy shares."""
    n, h, w = g.shape
    low, high = DB4, HIGH
    approx, details = g.astype(np.float64), []
    for _ in range(wavelet_levels(h, w, levels)):
        by_row = {k: analyse(approx, t) for k, t in (("a", low), ("d", high))}
        both = {k + m: np.swapaxes(analyse(np.swapaxes(v, 1, 2), t), 1, 2) for k, v in by_row.items() for m, t in (("a", low), ("d", high))}
        approx = both["aa"]
        details.insert(0, [both["ad"], both["da"], both["dd"]])
    bands = [approx, *(b for level in details for b in level)]
    energy = np.stack([(b**2).sum(axis=(1, 2)) for b in bands], axis=1)
    share = energy / (energy.sum(1, keepdims=True) + EPS)
    stats = [s for i, b in enumerate(bands) for s in (b.mean(axis=(1, 2)), b.std(axis=(1, 2)), energy[:, i])]
    return np.stack([*stats, share.mean(1), share.std(1)], axis=1)


def _lanczos(size: int, to: int) -> np.ndarray:
    """Weights of each old sample (columns) in each new one (rows), three lobes, widened when shrinking."""
    scale = max(1.0, size / to)
    centre = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None] + 0.5 - centre[:, None]) / scale
    k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return k / k.sum(1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """(row, column[, channel]) bytes to another size; samples are rounded to six decimals and then to levels, halves up, as pixels on rows are."""
    rows, cols = _lanczos(img.shape[0], height), _lanczos(img.shape[1], width)
    out = np.tensordot(rows, img.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(cols, out, (1, 1)), 0, 1)
    return np.clip(np.floor(np.floor(out * 1e6 + 0.5) / 1e6 + 0.5), 0, 255).astype(np.uint8)


def centre_crop(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled to cover the target, then cut around the centre."""
    h, w = img.shape[:2]
    scale = max(width / w, height / h)
    big = resize(img, max(width, round(w * scale)), max(height, round(h * scale)))
    top, left = (big.shape[0] - height) // 2, (big.shape[1] - width) // 2
    return big[top : top + height, left : left + width]


KERNELS = {
    "lbp": lbp_histogram,
    "glcm": glcm_features,
    "edge": edge_features,
    "fft": fft_features,
    "dct": dct_features,
    "wavelet": wavelet_features,
    "laplacian": lambda g: laplacian_variance(g)[:, None],
}

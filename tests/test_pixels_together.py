"""Images of one size are measured together, with the results that a plain form gives for each."""

import numpy as np
import pandas as pd

from inkscan.operators import image


def plain_peak(px, n=256):
    h, w = px.shape[:2]
    at = lambda size: np.minimum(size - 1, ((np.arange(n) + 0.5) * size / n).astype(int))
    luma = (px[at(h)][:, at(w)][..., :3] * [0.299, 0.587, 0.114]).sum(axis=2)
    edges = np.zeros((n, n))
    edges[1:-1, 1:-1] = 4 * luma[1:-1, 1:-1] - luma[1:-1, :-2] - luma[1:-1, 2:] - luma[:-2, 1:-1] - luma[2:, 1:-1]
    power = np.abs(np.fft.fft2(edges))
    ring = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if max(abs(dx), abs(dy)) >= 2 and dx and dy]
    peak = 0.0
    for f in (n // 2, n // 4, n // 8, n // 16):
        for fx, fy in ((f, 0), (0, f), (f, f)):
            around = sorted(power[(fy + dy) % n, (fx + dx) % n] for dy, dx in ring)
            peak = max(peak, power[fy, fx] / (around[len(around) // 2] or 1e-9))
    return peak


def plain_smooth(px, grid=16):
    h, w = px.shape[:2]
    bw, bh = max(3, w // grid), max(3, h // grid)
    step, shares, used = max(1, min(bw, bh) // 12), [], []
    noise = np.zeros((h, w, 2))
    noise[1:-1, 1:-1] = px[1:-1, 1:-1, :2] - (px[1:-1, :-2, :2] + px[1:-1, 2:, :2] + px[:-2, 1:-1, :2] + px[2:, 1:-1, :2]) / 4
    for gy in range(grid):
        for gx in range(grid):
            block = noise[gy * bh + 1 : min(h - 1, (gy + 1) * bh) : step, gx * bw + 1 : min(w - 1, (gx + 1) * bw) : step].reshape(-1, 2)
            if len(block):
                shares.append(np.abs(block[:, 1]).mean() < 0.8)
                used.append(block)
    r, g = np.concatenate(used).T
    return np.mean(shares), (r * g).sum() / np.sqrt((r * r).sum() * (g * g).sum())


def test_images_of_one_size_go_together():
    rnd = np.random.default_rng(5)
    made = [rnd.integers(0, 256, size, dtype=np.uint8) // part * part for part in (1, 64, 255) for size in ((64, 64, 4), (65, 90, 4), (64, 64, 4), (300, 70, 4))]
    calls = []

    def measure(px):
        calls.append(len(px))
        return zip(image.spectral_peaks(px), *image.smooth_shares(px)[:2])

    columns = [pd.Series(x, dtype=object) for x in ([m.shape[1] for m in made] + [64, 0, 8], [m.shape[0] for m in made] + [64, 9, 8], [m.tobytes() for m in made] + [None, b"", bytes(256)])]
    got = image._each(measure, 32, *columns)
    assert got[len(made) :] == [None] * 3
    assert sorted(calls) == [1, 1, 1, 3, 6]
    for m, (peak, share, together) in zip(made, got):
        assert np.isclose(peak, plain_peak(m.astype(float)), rtol=1e-9)
        assert (share, together) == tuple(map(float, plain_smooth(m.astype(float))))

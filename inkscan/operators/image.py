"""I-01 to I-07: from an image's metadata as columns, from its pixels in Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkscan.operators.base import add_up, register, result

# Who makes images, with what, and in which sizes; a standard quantisation table.
AI_ISSUERS = r"(?i)openai|dall[-·]?e|chatgpt|adobe firefly|firefly|google|imagen|gemini|midjourney|stability|bing image creator|microsoft designer|meta ai|ideogram|leonardo"
GENERATORS = r"(?i)stable diffusion|comfyui|automatic1111|invokeai|novelai|midjourney|dall[-·]?e|firefly|imagen|leonardo|fooocus|diffusers|flux"
PNG_KEYS = ("parameters", "workflow", "prompt", "Dream", "sd-metadata", "invokeai_metadata")
SIDES = (512, 576, 640, 704, 768, 832, 896, 960, 1024, 1152, 1216, 1280, 1344, 1536, 1792, 2048)
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def _of(field: str) -> Column:
    return F.col(f"image.{field}")


def _key(map_: str, key: str) -> Column:
    return F.coalesce(F.element_at(_of(map_), key), F.lit(""))


@register("I-01")
def manifest() -> Column:
    signed = _of("ai_claim") | F.exists(_of("issuers"), lambda i: i.rlike(AI_ISSUERS))
    return result("I-01", F.when(~_of("c2pa"), 0.0).when(signed, 1.0).otherwise(0.3))


@register("I-02")
def metadata() -> Column:
    keys = add_up([F.when(_key("png_text", k) != "", 2.0).otherwise(0.0) for k in PNG_KEYS])
    comment = F.when(_key("png_text", "Comment").rlike("(?i)steps|sampler|seed|cfg"), 2.0).otherwise(0.0)
    made = F.when(_key("exif", "Software").rlike(GENERATORS) | _key("png_text", "Software").rlike(GENERATORS), 2.0).otherwise(0.0)
    source = F.when(_of("xmp").rlike("(?i)trainedAlgorithmicMedia|compositeSynthetic|algorithmicMedia"), 2.0).otherwise(0.0)
    bare = F.when((_of("format") == "jpeg") & (_key("exif", "Make") == "") & (_key("exif", "Model") == ""), 0.5).otherwise(0.0)
    return result("I-02", keys + comment + made + source + bare)


@register("I-03")
def size() -> Column:
    w, h = _of("width"), _of("height")
    both = F.when(w.isin(*SIDES) & h.isin(*SIDES), 1.0).otherwise(0.0) + F.when((w % 64 == 0) & (h % 64 == 0), 0.6).otherwise(0.0)
    known = ((w == 1024) & (h == 1792)) | ((w == 1792) & (h == 1024)) | ((w == h) & w.isin(*SIDES))
    return result("I-03", both + F.when(known, 0.4).otherwise(0.0), (w > 0) & (h > 0))


def standard_tables() -> dict[str, int]:
    """Sorted tables of every quality of the standard encoder; the lowest quality of equal ones."""
    out: dict[str, int] = {}
    for q in range(1, 101):
        scale = 5000 / q if q < 50 else 200 - 2 * q
        out.setdefault(",".join(map(str, sorted(min(255, max(1, int((v * scale + 50) // 100))) for v in LUMA))), q)
    return out


@register("I-06")
def compression() -> Column:
    known = F.create_map(*(F.lit(x) for pair in standard_tables().items() for x in pair))
    table = F.array_join(F.array_sort(F.get(_of("quant"), F.lit(0))).cast("array<string>"), ",")
    quality = F.element_at(known, table)
    camera = (_key("exif", "Make") != "") | (_key("exif", "Model") != "")
    flags = F.when(quality.isNotNull() & ~camera, 1.0).otherwise(0.0) + F.when(quality >= 95, 0.5).otherwise(0.0)
    return result("I-06", flags, (_of("format") == "jpeg") & (F.size(_of("quant")) > 0))


#: Pixels that are worked on at once: images of one size go together.
AT_ONCE = 1 << 15


def _weighed(px: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    r, g, b = (px[..., k] * w for k, w in enumerate(weights))
    return r + g + b


@cache
def _spectral_layout(h: int, w: int, n: int) -> tuple:
    """Which pixels an image of that size gives, which rows and columns of its Laplacian differ, and where the lines and what is around them stand."""
    def differing(size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(size - 1, ((np.arange(n) + 0.5) * size / n).astype(int))
        threes, again = np.unique(np.stack([at[:-2], at[1:-1], at[2:]]), axis=1, return_inverse=True)
        edge = [threes.shape[1]]  # stands for the border
        return threes, np.concatenate([edge, again.ravel(), edge])

    lines = (n // 2, n // 4, n // 8, n // 16)
    columns = np.unique([(f + d) % n for f in (0, *lines) for d in range(-3, 4)])
    place = np.zeros(n, dtype=int)
    place[columns] = np.arange(len(columns))
    dy, dx = np.array([(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if max(abs(dx), abs(dy)) >= 2 and dx and dy]).T
    fx, fy = np.array([p for f in lines for p in ((f, 0), (0, f), (f, f))]).T
    return differing(h), differing(w), columns, place[fx] * n + fy, place[(fx[:, None] + dx) % n] * n + (fy[:, None] + dy) % n


def spectral_peaks(px: np.ndarray, n: int = 256) -> np.ndarray:
    """Per image (the first axis) the largest ratio of a spectral line at n/2, n/4, n/8, n/16 to the median around it, of the Laplacian of the luma.

    Of the spectrum only the columns around these lines are made; rows of the Laplacian that repeat are transformed once.
    """
    (rows, each_row), (xs, each_column), columns, lines, around = _spectral_layout(*px.shape[1:3], n)
    luma = _weighed(px, (0.299, 0.587, 0.114))
    out = np.zeros(len(px))
    edges = np.zeros((rows.shape[1] + 1, xs.shape[1] + 1))
    for i, whole in enumerate(luma):
        up, here, down = (whole[r] for r in rows)
        middle = xs[1]
        edges[:-1, :-1] = (4 * here)[:, middle] - here[:, xs[0]] - here[:, xs[2]] - up[:, middle] - down[:, middle]
        spread = np.fft.fft(edges[:, each_column], axis=1)[:, columns]
        power = np.abs(np.fft.fft(spread.T[:, each_row], axis=1)).ravel()
        near = np.sort(power[around], axis=1)[:, around.shape[1] // 2]
        out[i] = (power[lines] / np.where(near == 0, 1e-9, near)).max(initial=0.0)
    return out


def smooth_shares(px: np.ndarray, grid: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per image (the first axis) the share of blocks with little noise, the correlation of red and green noise, and each block's smoothness (0 to 1).

    Noise is counted in whole quarters, so sums are exact in any order.
    """
    h, w = px.shape[1:3]
    bw, bh = max(3, w // grid), max(3, h // grid)
    step = max(1, min(bw, bh) // 12)
    taken = [[np.arange(g * size + 1, min(end - 1, (g + 1) * size), step) for g in range(grid)] for size, end in ((bh, h), (bw, w))]
    (ny, ys), (nx, xs) = ((np.array([len(t) for t in axis if len(t)]), np.concatenate(axis)) for axis in taken)
    heat = np.ones((len(px), grid, grid))
    if not len(ys) or not len(xs):
        return np.zeros(len(px)), np.zeros(len(px)), heat
    q = px[..., :2].astype(np.int32)
    at = lambda dy, dx: q[:, ys + dy][:, :, xs + dx]
    noise = 4 * at(0, 0) - at(0, -1) - at(0, 1) - at(-1, 0) - at(1, 0)
    r, g = noise[..., 0].astype(np.int64), noise[..., 1].astype(np.int64)
    starts = lambda n: np.cumsum(n) - n
    total = np.add.reduceat(np.add.reduceat(np.abs(g), starts(ny), axis=1), starts(nx), axis=2)
    mean = total / 4 / (ny[:, None] * nx)
    heat[:, : len(ny), : len(nx)] = np.minimum(1.0, np.maximum(0.0, 1 - mean / 4))
    summed = lambda a, b: np.einsum("kyx,kyx->k", a, b) / 16
    spread = np.sqrt(summed(r, r) * summed(g, g))
    together = np.divide(summed(r, g), spread, out=np.zeros(len(px)), where=spread != 0)
    return (mean < 0.8).sum(axis=(1, 2)) / (len(ny) * len(nx)), together, heat


def watermark_strengths(px: np.ndarray, scale: float = 36) -> np.ndarray:
    """Per image (the first axis) the share of 4x4 blocks of the half-size chroma whose mean sits near a quarter of the scale."""
    h, w = px.shape[1] // 2 * 2, px.shape[2] // 2 * 2
    if min(h, w) < 16:
        return np.zeros(len(px))
    u = _weighed(px[:, :h, :w], (-0.14713, -0.28886, 0.436)) + 128
    low = (u[:, ::2, ::2] + u[:, ::2, 1::2] + u[:, 1::2, ::2] + u[:, 1::2, 1::2]) / 2
    rows, columns = low.shape[1] // 4, low.shape[2] // 4
    mean = low[:, : rows * 4, : columns * 4].reshape(-1, rows, 4, columns, 4).sum(axis=(2, 4)) / 4
    part = (mean / scale) % 1
    return ((np.abs(part - 0.25) < 0.1) | (np.abs(part - 0.75) < 0.1)).mean(axis=(1, 2))


def spectral_peak(px: np.ndarray, n: int = 256) -> float:
    """Of one image."""
    return float(spectral_peaks(px[None], n)[0])


def smooth_share(px: np.ndarray, grid: int = 16) -> tuple[float, float, np.ndarray]:
    """Of one image."""
    share, together, heat = smooth_shares(px[None], grid)
    return float(share[0]), float(together[0]), heat[0]


def watermark_strength(px: np.ndarray, scale: float = 36) -> float:
    """Of one image."""
    return float(watermark_strengths(px[None], scale)[0])


def _each(measure, least: int, width: pd.Series, height: pd.Series, data: pd.Series) -> list:
    """What ``measure`` makes of each image of at least that width and height, else null; images of one size go together."""
    out, sizes = [None] * len(data), {}
    for i, (w, h, d) in enumerate(zip(width, height, data, strict=True)):
        if d is not None and w and h and min(w, h) >= least:
            sizes.setdefault((int(h), int(w)), []).append(i)
    held = data.to_numpy()
    for (h, w), places in sizes.items():
        k = max(1, AT_ONCE // (h * w))
        for at in range(0, len(places), k):
            some = places[at : at + k]
            px = np.stack([np.frombuffer(held[i], dtype=np.uint8).reshape(h, w, 4) for i in some])
            for i, x in zip(some, measure(px), strict=True):
                out[i] = x
    return out


def _pixels(measure, least: int):
    @F.pandas_udf(DoubleType())
    def udf(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series(_each(measure, least, width, height, data), dtype="float64")

    value = udf("pixels.width", "pixels.height", "pixels.data")
    return F.when(F.isnan(value), None).otherwise(value)


@register("I-04")
def spectrum() -> Column:
    value = _pixels(spectral_peaks, 64)
    return result("I-04", value, value.isNotNull())


@register("I-05")
def noise() -> Column:
    def measure(px: np.ndarray) -> np.ndarray:
        share, together, _ = smooth_shares(px)
        return share + np.where(together > 0.97, 0.15, 0.0)

    value = _pixels(measure, 32)
    return result("I-05", value, value.isNotNull())


@register("I-07")
def watermark() -> Column:
    value = _pixels(watermark_strengths, 64)
    return result("I-07", value, value.isNotNull())


def heat_map(grid: int = 16) -> Column:
    """Rows of blocks of ``pixels`` with their smoothness; null where there are none, or the image is too small."""

    @F.pandas_udf("array<array<double>>")
    def udf(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series(_each(lambda px: smooth_shares(px, grid)[2].tolist(), 32, width, height, data), dtype=object)

    return udf("pixels.width", "pixels.height", "pixels.data")

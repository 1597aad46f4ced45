"""Operators on pixels and point pairs, in numpy, one group of rows at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Sizes of a patch that are tried, as parts of its own.
SCALES = (0.25, 0.3, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)


def decode(data: bytes) -> np.ndarray:
    """Pixels (rows x columns, or x 3) of a binary Netpbm image or a PNG with 8 bits a channel; others raise a ValueError."""
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        (w, h, most), depth = fields, 3 if data[1:2] == b"6" else 1
        if most > 255:
            raise ValueError("more than 8 bits a channel")
        flat = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
        return flat.reshape(h, w, depth) if depth == 3 else flat.reshape(h, w)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    raise ValueError("not a PNG or Netpbm image")


def _png(data: bytes) -> np.ndarray:
    at, parts, head, palette = 8, [], None, None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    w, h, bits, colour, _, _, interlaced = head
    if bits != 8 or interlaced:
        raise ValueError("only PNG with 8 bits a channel, not interlaced")
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h + 1, w + 1, depth), np.uint8)  # a row and a column of zeros come first
    for y, row in enumerate(rows, 1):
        x, up = row[1:].reshape(w, depth), out[y - 1, 1:]
        if row[0] == 0:
            out[y, 1:] = x
        elif row[0] == 1:
            out[y, 1:] = np.cumsum(x, axis=0, dtype=np.uint8)
        elif row[0] == 2:
            out[y, 1:] = x + up
        else:
            for k in range(w):
                a, b, c = (v.astype(int) for v in (out[y, k], out[y - 1, k + 1], out[y - 1, k]))
                if row[0] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                out[y, k + 1] = x[k] + guess
    out = out[1:, 1:]
    if colour == 3:
        return palette[out[..., 0]]
    return out[..., 0] if depth < 3 else out[..., :3]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an image in colour; a grey one stays."""
    return image if image.ndim == 2 else np.round(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """To another size: means of the covered areas where it shrinks, nearest pixels where it grows."""
    for axis, n in ((0, h), (1, w)):
        have = image.shape[axis]
        if n < have:
            edge = np.linspace(0, have, n + 1)
            sums = np.concatenate([np.zeros_like(np.take(image, [0], axis), float), np.cumsum(image, axis, dtype=float)], axis)
            low = np.minimum(edge.astype(int), have - 1)
            shape = [-1 if k == axis else 1 for k in range(image.ndim)]
            at = np.take(sums, low, axis) + (edge - low).reshape(shape) * np.take(image, low, axis)
            image = np.diff(at, axis=axis) / (have / n)
        elif n > have:
            image = np.take(image, np.minimum(((np.arange(n) + 0.5) * have / n).astype(int), have - 1), axis)
    return np.round(image).astype(np.uint8)


def blank(image: np.ndarray, least: float = 30.0) -> bool:
    return float(np.std(image)) < least


def pad_to(image: np.ndarray, step: int = 16) -> np.ndarray:
    h, w = image.shape[:2]
    return np.pad(image, [(0, -h % step), (0, -w % step)] + [(0, 0)] * (image.ndim - 2))


def shrink(image: np.ndarray, most: int) -> np.ndarray:
    """At most that many pixels a side, by nearest pixel."""
    h, w = image.shape[:2]
    f = min(1.0, most / max(h, w))
    return image[(np.arange(max(1, int(h * f))) / f).astype(int)[:, None], (np.arange(max(1, int(w * f))) / f).astype(int)]


def equalise(image: np.ndarray) -> np.ndarray:
    counts = np.bincount(image.ravel(), minlength=256)
    return (np.cumsum(counts) / image.size * 255).astype(np.uint8)[image]


def correlate(page: np.ndarray, patch: np.ndarray, centred: bool = True) -> tuple[float, int, int]:
    """Best normalised correlation of a patch with its place (row, column), by Fourier transform; centred: of the deviations from the means."""
    a, b = page.astype(float), patch.astype(float) - (patch.mean() if centred else 0)
    h, w = b.shape
    shape = (a.shape[0] + h - 1, a.shape[1] + w - 1)
    f = np.fft.irfft2(np.fft.rfft2(a, shape) * np.fft.rfft2(b[::-1, ::-1], shape), shape)[h - 1 : a.shape[0], w - 1 : a.shape[1]]

    def sums(x):
        s = np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    energy = sums(a * a) - (sums(a) ** 2 / (h * w) if centred else 0)
    spread = np.sqrt(np.maximum(energy, 1e-9) * (b * b).sum())
    score = np.where(spread > 1e-6, f / np.maximum(spread, 1e-6), 0)
    i = int(score.argmax())
    return float(score.flat[i]), *(int(x) for x in np.unravel_index(i, score.shape))


def template(page: np.ndarray, patch: np.ndarray, scales=SCALES) -> dict:
    """The best match over scales and both correlations, centred and not; patches under 20 pixels or larger than the page are left out.

    Page and patch are equalised before the patch is scaled.
    """
    page, patch, best = equalise(page), equalise(patch), {"score": 0.0, "y": 0, "x": 0, "scale": 1.0}
    for s in scales:
        h, w = int(patch.shape[0] * s), int(patch.shape[1] * s)
        if min(h, w) < 20 or h > page.shape[0] or w > page.shape[1]:
            continue
        scaled = resize(patch, h, w)
        for centred in (True, False):
            score, y, x = correlate(page, scaled, centred)
            if score > best["score"]:
                best = {"score": score, "y": y, "x": x, "scale": s}
    return best


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maps of several sets of points (sets x points x 2), without those that have no scale."""
    one, none = np.ones(a.shape[:2]), np.zeros(a.shape[:2])
    (x, y), (u, v) = (np.moveaxis(p, -1, 0) for p in (a, b))
    odd = np.stack([x, y, one, none, none, none, -u * x, -u * y, -u], axis=-1)
    even = np.stack([none, none, none, x, y, one, -v * x, -v * y, -v], axis=-1)
    h = np.linalg.svd(np.stack([odd, even], axis=2).reshape(len(a), -1, 9))[2][:, -1].reshape(-1, 3, 3)
    h = h[np.abs(h[:, 2, 2]) > 1e-12]
    return h / h[:, 2:, 2:]


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    h = _fits(a[None], b[None])
    return h[0] if len(h) else None


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ h.T
    return p[:, :2] / np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])


def homography(a: np.ndarray, b: np.ndarray, size: tuple[float, float], pixels: float = 8.0, rounds: int = 500, least: int = 8) -> dict:
    """A plane's map from point pairs by seeded random sampling: inliers and the box of the query's corners; with too few inliers the box of the points."""
    rng, best = np.random.default_rng(0), np.zeros(len(a), bool)
    picks = np.array([rng.choice(len(a), 4, replace=False) for _ in range(rounds if len(a) >= 4 else 0)], int).reshape(-1, 4)
    for k in range(0, len(picks), 50):
        h = _fits(a[picks[k : k + 50]], b[picks[k : k + 50]])
        p = np.c_[a, np.ones(len(a))] @ h.transpose(0, 2, 1)
        p = p[..., :2] / np.where(np.abs(p[..., 2:]) < 1e-12, 1e-12, p[..., 2:]) - b
        for good in np.hypot(p[..., 0], p[..., 1]) <= pixels:
            if good.sum() > best.sum():
                best = good
    if best.sum() >= max(4, least) and (h := _fit(a[best], b[best])) is not None:
        w, t = size
        points = project(h, np.array([[0, 0], [w, 0], [w, t], [0, t]], float))
    else:
        points = b[best] if best.sum() >= 3 else b
    if not len(points):
        return {"inliers": 0, "total": 0, "x1": 0.0, "y1": 0.0, "x2": 0.0, "y2": 0.0}
    (x1, y1), (x2, y2) = points.min(0), points.max(0)
    return {"inliers": int(best.sum()), "total": len(a), "x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2)}


def hamming_matches(a: np.ndarray, b: np.ndarray, below: int = 50, least: int = 5) -> int:
    """Mutual nearest binary descriptors (rows of bytes) closer than so many bits."""
    if len(a) < least or len(b) < least:
        return 0
    d = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    i, j = d.argmin(axis=1), d.argmin(axis=0)
    k = np.arange(len(a))
    return int(((j[i] == k) & (d[k, i] < below)).sum())


def localise(candidates, schema: str = "query_id long, page_id long, inliers long, total long, x1 double, y1 double, x2 double, y2 double"):
    """Rows of matched points (query_id, page_id, ax, ay, bx, by, w, h) to one box per query and page."""

    def run(frame):
        import pandas as pd

        got = homography(frame[["ax", "ay"]].to_numpy(), frame[["bx", "by"]].to_numpy(), (frame.w.iloc[0], frame.h.iloc[0]))
        return pd.DataFrame([{"query_id": frame.query_id.iloc[0], "page_id": frame.page_id.iloc[0], **got}])

    # few bytes but much work: a stated number of partitions is not put together again
    dealt = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "page_id")
    return dealt.groupBy("query_id", "page_id").applyInPandas(run, schema)


def by_padded_size(images, size: int, step: int = 16):
    """Images (path, height, width) with their padded size and a batch number: batches hold images of one padded size, at most so many."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    up = lambda c: (F.ceil(F.col(c) / step) * step).cast("int")
    out = images.withColumns({"padded_height": up("height"), "padded_width": up("width")})
    w = Window.partitionBy("padded_height", "padded_width").orderBy("path")
    return out.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))

"""Image files to tile sums.  This code runs in Python workers, one picture at a time."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

ROWS_PER_FRAME = 50_000
COLUMNS = ["image_path", "error", "ty", "tx", "n", "s", "s2"]

# Workers get these functions with the task instead of importing this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decode_gray(content: bytes) -> np.ndarray:
    """Grey levels of a binary PGM; other formats through Pillow where it is installed."""
    if content[:2] == b"P5":
        fields: list[bytes] = []
        at = 2
        while len(fields) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(content[at:end])
            at = end
        width, height, top = (int(f) for f in fields)
        kind = np.uint8 if top < 256 else np.dtype(">u2")
        return np.frombuffer(content, kind, width * height, at + 1).reshape(height, width)
    import io

    from PIL import Image, ImageOps  # optional

    return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("L"))


def _axis_weights(size: int, target: int) -> np.ndarray:
    """Triangle-filter weights taking ``size`` samples to ``target`` of them."""
    step = size / target
    centers = (np.arange(target) + 0.5) * step
    w = np.clip(1 - np.abs(np.arange(size) + 0.5 - centers[:, None]) / step, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def shrink(gray: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Scale down so that no side exceeds ``longest``; without it the picture stays as it is."""
    if not longest or max(gray.shape) <= longest:
        return gray
    scale = max(gray.shape) / longest
    h, w = (max(1, round(s / scale)) for s in gray.shape)
    small = _axis_weights(gray.shape[0], h) @ gray.astype(float) @ _axis_weights(gray.shape[1], w).T
    return np.rint(small)


def _tile_rows(path: str, gray: np.ndarray, side: int) -> pd.DataFrame:
    values = gray.astype(float)
    ys, xs = (np.arange(0, size, side) for size in values.shape)

    def sums(a: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(a, ys, axis=0), xs, axis=1)

    ty, tx = np.meshgrid(np.arange(len(ys)), np.arange(len(xs)), indexing="ij")
    return pd.DataFrame(
        {
            "image_path": path,
            "error": None,
            "ty": ty.ravel(),
            "tx": tx.ravel(),
            "n": sums(np.ones_like(values)).ravel().astype("int64"),
            "s": sums(values).ravel(),
            "s2": sums(values * values).ravel(),
        }
    )


def tile_rows_of(
    decoder: Callable[[bytes], np.ndarray], longest: int | None, side: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batch function from (path, content) to tile rows; an unreadable file gives one row with its error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    held.append(_tile_rows(path, shrink(decoder(bytes(content)), longest), side))
                except Exception as problem:
                    held.append(pd.DataFrame({"image_path": [path], "error": [f"Error: {problem}"]}).reindex(columns=COLUMNS))
                if sum(map(len, held)) >= ROWS_PER_FRAME:
                    yield pd.concat(held, ignore_index=True)
                    held = []
        if held:
            yield pd.concat(held, ignore_index=True)

    return decode

"""Bounding-box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox_normalize(x1: str, y1: str, x2: str, y2: str, width: str, height: str) -> dict[str, Column]:
    """Corner pixels to centre and size as shares of the image."""
    w, h = F.nullif(F.col(width), F.lit(0)), F.nullif(F.col(height), F.lit(0))
    left, top, right, bottom = F.col(x1) / w, F.col(y1) / h, F.col(x2) / w, F.col(y2) / h
    return {
        "x_center": (left + right) / 2,
        "y_center": (top + bottom) / 2,
        "box_width": right - left,
        "box_height": bottom - top,
    }

"""Product codes from file names and free text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that count as images.
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp"]

# Fixed pattern: leading token of a file name.
LEADING_TOKEN = r"^([A-Za-z0-9_-]+)"
# Fixed pattern: the token that follows the word "sku".
SKU_MENTION = r"(?i)(?:^|\b)sku\s*[:#]?\s*([\w\-]+)"


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    # The ending is the part after the last dot, unless that dot opens or closes the name.
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def file_ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def sku_from_path(path: Column | str, pattern: str | None = None) -> Column:
    """Code found in the file stem: group 1 of ``pattern`` if it has one, else its whole match; "" if none."""
    c = _stem(F.col(path) if isinstance(path, str) else path)
    if pattern is None:
        return F.regexp_extract(c, LEADING_TOKEN, 1)
    group = 1 if re.compile(pattern).groups else 0
    return F.regexp_extract(c, pattern, group)


def sku_from_text(text: Column | str) -> Column:
    """Token after the first mention of "sku"; NULL without one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(c, SKU_MENTION, 1), F.lit(""))

"""Shelf-gap scores: how much of a shelf picture is flat.

Only sums per tile (pixels, brightness, brightness squared) leave a picture, and everything else follows from
them: a tile is whole if it holds tile x tile pixels, its variance comes from its sums, and adding tiles up
gives the whole picture's variance.  Pictures may arrive as pixel rows or as image files.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.paths import sku_from_path
from larder.functions.pictures import decode_gray, tile_rows_of

TILE, SMALLEST_TILE = 48, 8
UNIFORM_BELOW = 800.0
VARIANCE_REFERENCE = 5000.0

TILE_SCHEMA = "image_path string, error string, ty int, tx int, n long, s double, s2 double"


def tile_sums(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Sums per tile from pixel rows (image, y, x, lum).  Tiles are small, so no image is one group."""
    side = max(SMALLEST_TILE, int(tile))
    lum = F.col("lum").cast("double")
    return pixels.groupBy(
        "image", F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(lum).alias("s"), F.sum(lum * lum).alias("s2"))


def _variance(n: Column, s: Column, s2: Column) -> Column:
    mean = s / n
    return F.greatest(s2 / n - mean * mean, F.lit(0.0))


def _global_score(variance: Column, reference: float) -> Column:
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), variance / reference))


def score_tiles(
    tiles: DataFrame,
    key: str = "image",
    mode: str = "local",
    tile: int = TILE,
    uniform_below: float = UNIFORM_BELOW,
    reference: float = VARIANCE_REFERENCE,
    also: list[Column] | None = None,
) -> DataFrame:
    """(gap_score, mode, notes) per picture, plus any further aggregates asked for in ``also``.

    global: 1 - variance / reference, between 0 and 1.  local: share of whole tiles whose variance is below
    the limit; a picture without a whole tile is scored globally.
    """
    side = max(SMALLEST_TILE, int(tile))
    whole = F.col("n") == side * side
    flat = whole & (_variance(F.col("n"), F.col("s"), F.col("s2")) < uniform_below)
    per_image = tiles.groupBy(key).agg(
        F.count_if(whole).alias("tiles"),
        F.count_if(flat).alias("uniform"),
        _variance(F.sum("n"), F.sum("s"), F.sum("s2")).alias("variance"),
        *(also or []),
    )
    extra = [c for c in per_image.columns if c not in (key, "tiles", "uniform", "variance")]
    variance = F.col("variance")
    score = _global_score(variance, reference)
    if mode == "global":
        kind = F.lit("global")
        notes = F.format_string(f"global var=%.1f (ref={reference:g})", variance)
    else:
        share = F.try_divide(F.col("uniform").cast("double"), F.col("tiles"))
        local = F.col("tiles") > 0
        score = F.when(local, share).otherwise(score)
        kind = F.when(local, "local").otherwise("global")
        notes = F.when(
            local,
            F.format_string(
                f"local tiles=%d, uniform=%d (%.2f%%), thresh={uniform_below:g}", "tiles", "uniform", share * 100
            ),
        ).otherwise(F.format_string("fallback-global (image too small), var=%.1f", variance))
    return per_image.select(
        key, F.bround(score, 3).alias("gap_score"), kind.alias("mode"), notes.alias("notes"), *extra
    )


def shelf_gap_global(pixels: DataFrame, reference: float = VARIANCE_REFERENCE) -> DataFrame:
    return score_tiles(tile_sums(pixels), mode="global", reference=reference)


def shelf_gap_local(pixels: DataFrame, tile: int = TILE, uniform_below: float = UNIFORM_BELOW) -> DataFrame:
    return score_tiles(tile_sums(pixels, tile), mode="local", tile=tile, uniform_below=uniform_below)


def image_tiles(
    files: DataFrame,
    tile: int = TILE,
    longest: int | None = None,
    decoder: Callable[[bytes], np.ndarray] = decode_gray,
) -> DataFrame:
    """Tile sums of image files (path, content); an unreadable file gives one row with its error.

    Pictures keep their size unless ``longest`` bounds their longer side.  A worker decodes one picture at a time.  The
    encoded files of a task reach it together at most: the file scan packs no more than
    ``spark.sql.files.maxPartitionBytes`` of them into a task, or one larger file.
    """
    side = max(SMALLEST_TILE, int(tile))

    return files.select("path", "content").mapInPandas(tile_rows_of(decoder, longest, side), TILE_SCHEMA)


def gap_batch(
    files: DataFrame,
    mode: str = "local",
    sku_pattern: str | None = None,
    tile: int = TILE,
    uniform_below: float = UNIFORM_BELOW,
    reference: float = VARIANCE_REFERENCE,
    longest: int | None = None,
    decoder: Callable[[bytes], np.ndarray] = decode_gray,
    fail_on_no_sku: bool = False,
) -> DataFrame:
    """Score every image file: (sku, gap_score, mode, notes, image_path).  Files are independent rows.

    An unreadable file scores 0 with the error in its notes.
    """
    tiles = image_tiles(files, tile, longest, decoder)
    # An error row has no pixels; give it one so that it passes the arithmetic, then overwrite its score.
    counted = tiles.withColumns(
        {"n": F.coalesce("n", F.lit(1)), "s": F.coalesce("s", F.lit(0.0)), "s2": F.coalesce("s2", F.lit(0.0))}
    )
    error = F.max("error").alias("error")
    scored = score_tiles(counted, "image_path", mode, tile, uniform_below, reference, [error])
    failed = F.col("error").isNotNull()
    sku = sku_from_path(F.col("image_path"), sku_pattern)
    if fail_on_no_sku:
        sku = F.when(sku == "", F.raise_error(F.concat(F.lit("no sku in file name: "), "image_path")).cast("string")).otherwise(sku)
    return scored.select(
        sku.alias("sku"),
        F.when(failed, 0.0).otherwise(F.col("gap_score")).alias("gap_score"),
        F.when(failed, mode).otherwise(F.col("mode")).alias("mode"),
        F.when(failed, F.col("error")).otherwise(F.col("notes")).alias("notes"),
        "image_path",
    )

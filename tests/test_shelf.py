"""Shelf scores against numpy."""

import numpy as np
import pytest

from larder.functions.pictures import decode_gray, shrink
from larder.plans.shelf import gap_batch, shelf_gap_global, shelf_gap_local
from larder.sources.readers import scan_images


def shelf_picture():
    picture = np.full((240, 320), 220, np.uint8)
    picture[:, 100:140] = np.random.default_rng(0).integers(150, 255, size=(240, 40), dtype=np.uint8)
    return picture


def pgm(picture) -> bytes:
    height, width = picture.shape
    return f"P5\n# made for a test\n{width} {height}\n255\n".encode() + picture.tobytes()


def local_share(picture, tile):
    h, w = (s - s % tile for s in picture.shape)
    tiles = picture[:h, :w].astype(float).reshape(h // tile, tile, w // tile, tile).swapaxes(1, 2)
    variances = tiles.reshape(h // tile, w // tile, -1).var(axis=-1)
    return (variances < 800).mean(), variances.size


def pixel_rows(spark, picture):
    rows = [("p", y, x, int(v)) for (y, x), v in np.ndenumerate(picture)]
    return spark.createDataFrame(rows, "image string, y int, x int, lum int")


def test_pixels_and_files_agree_with_numpy(spark):
    picture = shelf_picture()[:90, :150]
    share, count = local_share(picture, 40)
    row = shelf_gap_local(pixel_rows(spark, picture), tile=40).first()
    assert row["gap_score"] == round(share, 3) and f"tiles={count}" in row["notes"]
    whole = shelf_gap_global(pixel_rows(spark, picture)).first()
    assert whole["gap_score"] == pytest.approx(round(1 - min(1, picture.var() / 5000), 3)) and "var=" in whole["notes"]
    files = spark.createDataFrame([("/a/SKU-1 x.pgm", bytearray(pgm(picture)))], "path string, content binary")
    got = gap_batch(files, tile=40).first()
    assert (got["sku"], got["gap_score"], got["notes"]) == ("SKU-1", row["gap_score"], row["notes"])


def test_small_picture_falls_back_and_bad_file_scores_zero(spark):
    files = spark.createDataFrame(
        [("/a/small.pgm", bytearray(pgm(shelf_picture()[:5, :5]))), ("/a/(x).png", bytearray(b"not a picture"))],
        "path string, content binary",
    )
    rows = {r["image_path"]: r for r in gap_batch(files).collect()}
    assert rows["/a/small.pgm"]["mode"] == "global" and rows["/a/small.pgm"]["gap_score"] == 1.0
    bad = rows["/a/(x).png"]
    assert (bad["sku"], bad["gap_score"], bad["mode"]) == ("", 0.0, "local") and bad["notes"].startswith("Error")


def test_folder_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.PNG", "deep/b.jpeg", "c.txt", "deep/d"):
        (tmp_path / name).write_bytes(pgm(shelf_picture()))
    found = scan_images(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.PNG", "b.jpeg"]
    assert {r["mode"] for r in gap_batch(found, mode="global").collect()} == {"global"}


def test_shrinking_keeps_mean_and_limits_size():
    picture = np.random.default_rng(1).integers(0, 255, size=(300, 2048)).astype(float)
    small = shrink(picture, 1024)
    assert small.shape == (150, 1024) and abs(small.mean() - picture.mean()) < 1
    assert shrink(picture, None) is picture
    wide = (np.arange(6) * 1000).astype(">u2").tobytes()
    assert decode_gray(b"P5 3 2 65535\n" + wide).tolist() == [[0, 1000, 2000], [3000, 4000, 5000]]

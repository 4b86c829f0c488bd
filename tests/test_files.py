"""Readers and writers."""

from __future__ import annotations

import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest

from strandlake.operators import raster
from strandlake.sources import files


def test_matrix_is_read_by_columns(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2\n3 4\n")
    got = {(r["r0"], r["c0"]): r["v"] for r in files.read_matrix(spark, str(tmp_path / "m.txt"), size=2).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 4.0}
    with pytest.raises(Exception, match="expected"):
        files.read_matrix(spark, str(tmp_path / "m.txt"), size=3).collect()


def test_positions(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2 3\n4 ")
    assert [(r["id"], r["x"], r["y"]) for r in files.read_positions(spark, str(tmp_path / "p.txt")).orderBy("id").collect()] == [(1, 1.0, 2.0), (2, 3.0, 4.0)]
    (tmp_path / "q.txt").write_text("1 2 3")
    with pytest.raises(Exception, match="odd"):
        files.read_positions(spark, str(tmp_path / "q.txt")).collect()


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_matrix(spark, str(tmp_path / "none.txt"))


def test_areas_and_placements_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("C2", 1.5), ("C4", 2.0)], "label string, area double")
    files.write_areas(a, str(tmp_path / "a"))
    assert sorted(map(tuple, files.read_areas(spark, str(tmp_path / "a")).collect())) == [("C2", 1.5), ("C4", 2.0)]
    p = spark.createDataFrame([(1.0, 2.0, 3)], files.PLACEMENT_SCHEMA)
    files.write_placements(p, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True, schema=files.PLACEMENT_SCHEMA).first() == (1.0, 2.0, 3)


def test_states_skip_corrupt_files(spark, tmp_path):
    at = files.write_checkpoint({"monomers": spark.createDataFrame([(7, 1)], "run_id long, id long")}, str(tmp_path), "hc15", 1, "final", datetime(2024, 1, 2, 3, 4, 5))
    assert at == f"{tmp_path}/hc15_20240102_030405_1_final"
    (tmp_path / "hc15_20240102_030405_1_final/monomers/run_id=7/broken_C9_.parquet").write_bytes(b"no table")
    with pytest.warns(UserWarning, match="broken_C9_"):
        got = files.read_states(spark, f"{at}/monomers").collect()
    assert [r["id"] for r in got] == [1] and got[0]["file"].startswith("part-")
    with pytest.raises(ValueError, match="tag"):
        files.write_checkpoint({}, str(tmp_path), "x", 1, "other", datetime(2024, 1, 2))


def test_numbers_of_many_splits(spark, tmp_path):
    rng = random.Random(1)
    text, n = [], 0
    while n < 3000:
        k = rng.randrange(4)
        text.append(" ".join(str(n + i) for i in range(k)))
        n += k
    (tmp_path / "many.txt").write_text("\n".join(text))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in names]
    for k in names:
        spark.conf.set(k, "1500")
    try:
        assert spark.read.text(str(tmp_path / "many.txt")).rdd.getNumPartitions() > 3
        got = files._numbers(spark, str(tmp_path / "many.txt")).collect()
        assert sorted((r["i"], r["v"]) for r in got) == [(i, float(i)) for i in range(n)]
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)


def _png(a, filters):
    """A PNG of (rows, columns, channels) with the given filter of each row."""
    h, w, c = a.shape
    x, rows = np.zeros((h + 1, w + 1, c), int), []
    x[1:, 1:] = a
    for i in range(h):
        cur, left, up, corner = x[i + 1, 1:], x[i + 1, :-1], x[i, 1:], x[i, :-1]
        guess = left + up - corner
        d = np.stack((abs(guess - left), abs(guess - up), abs(guess - corner)))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        rows.append(bytes([filters[i]]) + ((cur - (0, left, up, (left + up) // 2, paeth)[filters[i]]) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 2: 4, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(spark, tmp_path, channels):
    a = np.random.default_rng(channels).integers(0, 256, (6, 5, channels))
    raw = _png(a, [0, 1, 2, 3, 4, 4])
    want = a[:, :, 0] if channels < 3 else np.round(a[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
    assert (files.decode_png(raw) == want).all()
    (tmp_path / "i.png").write_bytes(raw)
    got = {(r["row"], r["col"]): r["gray"] for r in files.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {(i, j): want[i, j] for i in range(6) for j in range(5)}


def test_raster(spark, tmp_path):
    (tmp_path / "i.pgm").write_bytes(b"P5\n# made here\n2 1\n255\n" + bytes([7, 200]))
    assert [(r["row"], r["col"], r["gray"]) for r in files.read_rasters(spark, str(tmp_path)).orderBy("col").collect()] == [(0, 0, 7), (0, 1, 200)]


def test_images_to_islands(spark, tmp_path):
    """From files to measures by hand: dots grow to 3 x 3; those two apart touch, those three apart do not."""
    a = np.full((7, 12), 200, np.uint8)
    a[3, [1, 3, 7]] = 0  # a bar of 3 x 5, and a square from column 6 on
    a[0, 11] = 49  # a corner of 2 x 2
    a[6, 11] = 50  # not dark
    (tmp_path / "i.pgm").write_bytes(b"P5\n12 7\n255\n" + a.tobytes())
    (tmp_path / "blank.pgm").write_bytes(b"P5\n2 2\n255\n" + bytes([99] * 4))
    got = {r["img"].rsplit("/", 1)[1]: (r["density"], r["islands"], r["max_area"], r["mean_area"]) for r in raster.island_stats(files.read_rasters(spark, str(tmp_path))).collect()}
    assert got == {"i.pgm": (round(28 / 84, 6), 3, 15, pytest.approx(28 / 3, abs=1e-6)), "blank.pgm": (0.0, 0, None, None)}

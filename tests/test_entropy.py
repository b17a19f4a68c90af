"""Parses, suffix arrays, calibration by random images, its interpolation, and compressibility by decimation."""

from __future__ import annotations

import random
import time

import duckdb
import numpy as np
import pytest

from pixelloom.operators import entropy


def rows_of(comp, bin, image):
    return [(comp, bin, int(x), int(y), int(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]


SCHEMA = "comp_id string, bin int, x int, y int, color int"


def test_suffix_array():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 17, 100):
        for letters in (1, 2, 4):
            s = bytes(rng.randrange(letters) for _ in range(n))
            assert entropy.suffix_array(np.frombuffer(s, np.uint8)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_parse_of_a_large_image_takes_seconds_and_restores_it():
    rng = np.random.default_rng(1)
    noisy = rng.integers(0, 32, 300_000, dtype=np.uint8).tobytes()
    blocks = np.repeat(rng.integers(0, 4, 3000, dtype=np.uint8), 100).tobytes()
    for symbols in (noisy, blocks, bytes(300_000)):
        began = time.time()
        lengths = entropy.lz77_lengths(symbols)
        assert sum(lengths) == len(symbols) and time.time() - began < 60
    assert lengths == [1, 299_999]
    assert entropy.lz77_lengths(b"abababac") == [1, 1, 5, 1]
    assert entropy.lz77_bits(b"abababac") == pytest.approx(0 + 0 + (1 + np.log2(5)) + np.log2(7))


def test_haar_levels_and_sums():
    assert entropy.haar_levels((1, 5)) is None and entropy.haar_levels((3, 3)) == (1, 1, 1)
    # 64 pixels: centres 3, 6, 12, 24, 48, 96; a tenth is 6.4, level 2; four tenths are 25.6, level 4
    assert entropy.haar_levels((64, 80)) == (1, 2, 4)
    # 8 pixels: the tenth is nearest to level 1, which is taken, so 2; 3.2 is nearest to level 1, taken, so 2 as well
    assert entropy.haar_levels((8, 8)) == (1, 2, 2)
    assert entropy.haar_energies(np.zeros((1, 5))) == (0.0, 0.0, 0.0)
    # blocks of 2 x 2 vanish in the first step; the second step sees 2 * [[1, 0], [0, 0]]: three details of 1 each
    image = np.kron([[1, 0], [0, 0]], np.ones((2, 2)))
    assert entropy.haar_energies(image)[0] == pytest.approx(3.0)


def test_hilbert_sizes_are_padded_to_a_square():
    image = np.arange(15, dtype=np.uint8).reshape(3, 5) + 1
    symbols = entropy.flat(image, "hilbert")
    assert len(symbols) == 64 and sorted(symbols) == [0] * 49 + list(range(1, 16))
    assert entropy.flat(image, "rows") == bytes(range(1, 16))
    assert entropy.flat(np.ones((1, 1), np.uint8), "hilbert") == b"\x01"


def test_bounds_by_area_and_palette(spark):
    squares = spark.createDataFrame([(s, k) for s in (1, 2, 8) for k in (2, 8)], "side int, palette int")
    found = {(r.palette, r.area): r for r in entropy.entropy_bounds(squares, trials=4).collect()}
    for side in (1, 2, 8):
        for palette in (2, 8):
            draws = [np.random.default_rng([side, palette, t]).integers(0, palette, (side, side), dtype=np.uint8) for t in range(4)]
            r = found[palette, side * side]
            assert r.entropy_min == pytest.approx(1 / side**2)
            assert r.entropy_max == pytest.approx(np.mean([entropy.lz77_factors(d.tobytes()) / side**2 for d in draws]))
    assert found[8, 64].entropy_max > found[2, 64].entropy_max > found[2, 64].entropy_min


def test_interpolation_by_hand_and_by_sql(spark):
    bounds = [(8, 4, 0.25, 0.75), (8, 9, 1 / 9, 0.6), (8, 16, 1 / 16, 0.5), (3, 4, 0.25, 0.25)]
    asked = [("a", 1, 8, 4, 0.5), ("a", 2, 8, 6, 0.5), ("b", 1, 8, 16, 0.1), ("b", 2, 8, 17, 0.1), ("b", 3, 8, 3, 0.1), ("c", 1, 3, 4, 0.25), ("c", 2, 5, 4, 0.25), ("a", 3, 8, 6, 0.4)]
    known = spark.createDataFrame(bounds, "palette int, area long, entropy_min double, entropy_max double")
    images = spark.createDataFrame(asked, "comp_id string, bin int, palette int, area int, entropy double")
    got = {(r.comp_id, r.bin): r.normalized for r in entropy.normalized_entropies(images, known).collect()}
    assert got["a", 1] == pytest.approx(0.5)
    low, high = 0.25 + 0.4 * (1 / 9 - 0.25), 0.75 + 0.4 * (0.6 - 0.75)  # six pixels: two fifths of the way from 4 to 9
    assert got["a", 2] == pytest.approx((0.5 - low) / (high - low)) and got["a", 3] == pytest.approx((0.4 - low) / (high - low))
    assert got["b", 1] == pytest.approx((0.1 - 1 / 16) / (0.5 - 1 / 16))
    assert got["b", 2] is None and got["b", 3] is None and got["c", 1] is None and got["c", 2] is None
    con = duckdb.connect()
    con.execute("CREATE TABLE known(palette INT, area BIGINT, lo DOUBLE, hi DOUBLE)")
    con.execute("CREATE TABLE asked(comp_id VARCHAR, bin INT, palette INT, area INT, entropy DOUBLE)")
    con.executemany("INSERT INTO known VALUES (?, ?, ?, ?)", bounds)
    con.executemany("INSERT INTO asked VALUES (?, ?, ?, ?, ?)", asked)
    sql = """SELECT a.comp_id, a.bin, (entropy - (l.lo + w * (h.lo - l.lo))) / nullif((l.hi + w * (h.hi - l.hi)) - (l.lo + w * (h.lo - l.lo)), 0)
        FROM asked a ASOF LEFT JOIN known l ON l.palette = a.palette AND l.area <= a.area ASOF LEFT JOIN known h ON h.palette = a.palette AND h.area >= a.area,
        LATERAL (SELECT CASE WHEN h.area > l.area THEN (a.area - l.area) / (h.area - l.area) ELSE 0 END AS w)"""
    for comp, bin, value in con.execute(sql).fetchall():
        assert got[comp, bin] == (None if value is None else pytest.approx(value))




@pytest.mark.parametrize("flattening", ["rows", "hilbert"])
def test_decimations_equal_slices(spark, flattening):
    rng = np.random.default_rng(7)
    images = {("a", 1): rng.integers(0, 3, (9, 7)), ("a", 2): np.tile([[0, 1], [2, 3]], (4, 5)), ("b", 1): rng.integers(0, 5, (4, 12)), ("b", 2): np.zeros((1, 6), int)}
    df = spark.createDataFrame([r for (c, b), im in images.items() for r in rows_of(c, b, im + 0)], SCHEMA)
    got = {}
    for r in entropy.decimations(df).collect():
        got.setdefault((r.comp_id, r.bin, r.delta, r.start), {})[r.y, r.x] = r.color
    for (c, b), image in images.items():
        for delta in range(1, image.shape[0] // 2 + 1):
            for start in range(delta):
                part = image[start::delta, start::delta]
                assert got.pop((c, b, delta, start), {}) == {(y, x): part[y, x] for y in range(part.shape[0]) for x in range(part.shape[1])}
    assert not got
    q = {(r.comp_id, r.bin, r.delta): r.q for r in entropy.compressibility(df, flattening).collect()}
    again = {(r.comp_id, r.bin, r.delta): r.q for r in entropy.compressibility(df.repartition(7), flattening).collect()}
    assert q == again and set(q) == {(c, b, d) for (c, b), im in images.items() for d in range(1, im.shape[0] // 2 + 1)}
    assert q["a", 2, 1] > 0.2 and abs(q["a", 1, 1]) < 0.25  # a pattern and noise
    assert q["a", 2, 2] == 0  # each of its decimations has one colour, and so is its own shuffle


def test_images_and_rates(spark):
    rng = np.random.default_rng(9)
    images = {("a", 1): rng.integers(0, 4, (12, 12)), ("a", 2): np.zeros((12, 12), int), ("b", 1): np.array([[5]])}
    df = spark.createDataFrame([r for (c, b), im in images.items() for r in rows_of(c, b, im)], SCHEMA)
    sizes = {(r.comp_id, r.bin): r for r in entropy.image_entropies(df).collect()}
    for key, image in images.items():
        assert sizes[key].area == image.size and sizes[key].size == entropy.lz77_factors(image.astype(np.uint8).tobytes())
    rates = {(r.comp_id, r.bin): r for r in entropy.image_entropy_rates(df).collect()}
    assert rates["a", 1].rate_lz77 > 1.3 > 0.5 > rates["a", 2].rate_lz77 and rates["a", 1].rows_lz77_bits > 1
    kernels = {(r.comp_id, r.bin): r for r in entropy.image_kernels(df).collect()}
    assert kernels["a", 2].n_lz77 == 2 and kernels["a", 2].haar_high == 0 and kernels["a", 1].haar_high > 0

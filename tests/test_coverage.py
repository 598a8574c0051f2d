"""Coverage of tiles by classes of a mask, and vectors put back to regions."""

import numpy as np
import pytest

from tesserae.operators import coverage, spatial

RNG = np.random.default_rng(8)


def test_area_between_pixels():
    mask = RNG.integers(0, 2, (5, 7))
    table = coverage.summed(mask)
    fine = np.kron(mask, np.ones((10, 10))) / 100
    for _ in range(50):
        y, x = RNG.integers(0, 51) / 10, RNG.integers(0, 71) / 10
        assert abs(coverage.area(table, np.array([y]), np.array([x]))[0] - fine[: round(y * 10), : round(x * 10)].sum()) < 1e-9
    assert coverage.area(table, np.array([99.0]), np.array([-3.0]))[0] == 0 and coverage.area(table, np.array([99.0]), np.array([99.0]))[0] == mask.sum()


def test_coverage_against_loops(spark):
    masks = {"a": RNG.integers(0, 4, (9, 6)), "b": RNG.integers(0, 3, (4, 11))}
    rows = [(k, m.ravel().tolist(), m.shape[1], 10.0) for k, m in masks.items()] + [("c", None, 4, 10.0), ("e", [], 4, 10.0)]
    tiles = [(k, int(x), int(y), int(s), "other") for k in "abcde" for x, y, s in zip(RNG.integers(-20, 110, 30), RNG.integers(-20, 90, 30), RNG.integers(1, 40, 30))]
    settings = {"pixel_mapping": {"none": 0, "one": 1, "two": 2}, "min_coverage": {"none": None, "one": 0.25, "two": 0.0}}
    t = spark.createDataFrame(tiles, "sample_id string, x long, y long, size long, mask string")
    m = spark.createDataFrame(rows, "sample_id string, mask array<long>, mask_width int, mask_downsample double")
    got = {(r.sample_id, r.x, r.y, r.size, r.annotation): r.coverage for r in coverage.coverage(t, m, {"one": 1, "two": 2}).collect()}
    assert {k[0] for k in got} == set("abce")
    for k, x, y, s, _ in tiles:
        for name, value in (("one", 1), ("two", 2)):
            if k in masks:
                big = np.pad(np.kron(masks[k] == value, np.ones((10, 10))), 300)
                want = big[300 + y : 300 + y + s, 300 + x : 300 + x + s].mean()
                assert abs(got[k, x, y, s, name] - want) < 1e-9
            elif k != "d":
                assert got[k, x, y, s, name] == 0
    kept = {(r.sample_id, r.x, r.y, r.size, r.annotation) for r in coverage.select(t, m, settings).collect()}
    assert kept == {k for k, c in got.items() if c >= settings["min_coverage"][k[4]] - 1e-12}
    merged = [(r.sample_id, r.x, r.y, r.size, r.annotation, r.coverage) for r in coverage.select(t, m, settings | {"output_mode": "merged"}).collect()]
    best = {}
    for k in kept:
        best[k[:4]] = max(best.get(k[:4], 0), got[k])
    assert len(merged) == len(best) and {k[:4]: k[5] for k in merged} == best and {k[4] for k in merged} == {None}
    with pytest.raises(ValueError, match="no mask values"):
        coverage.select(t, m, {"pixel_mapping": {}, "min_coverage": {"x": 0.1}})
    with pytest.raises(ValueError, match="is a share"):
        coverage.select(t, m, {"pixel_mapping": {"x": 1}, "min_coverage": {"x": 1.5}})
    with pytest.raises(Exception, match="2 masks of"):
        coverage.coverage(t, m.union(m), {"one": 1}).count()
    assert coverage.coverage(t.limit(0), m, {"one": 1}).count() == 0


def test_scatter(spark):
    schema = "sample_id string, flat_index int, embedding array<float>"
    rows = [("a", i, [float(i), 0.5]) for i in range(6)] + [("b", i, [float(i), 1.5]) for i in range(3)]
    regions = spark.createDataFrame([("a", 2), ("b", 1), ("none", 0)], "sample_id string, num_regions int")
    made = lambda r: spatial.scatter(spark.createDataFrame(r, schema).repartition(3), regions, 3).collect()
    order = RNG.permutation(len(rows))
    got = {(r.sample_id, r.region_index): [v[0] for v in r.embedding] for r in made([rows[i] for i in order])}
    assert got == {("a", 0): [0, 1, 2], ("a", 1): [3, 4, 5], ("b", 0): [0, 1, 2]}
    for bad, what in ((rows[:4] + rows[5:], "no vectors for subtiles 4 of a"), (rows[:6], "no vectors for subtiles 0, 1, 2 of b"), (rows + rows[3:5], "several vectors for subtiles 3, 4 of a"), ([*rows, ("b", 7, [0.0, 0.0])], "no region for subtiles 7 of b")):
        with pytest.raises(Exception, match=what):
            made(bad)

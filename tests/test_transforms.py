"""Fused transforms equal the steps one by one."""

import itertools

import numpy as np
import pytest

from tesserae.functions.pixels import WEIGHTS
from tesserae.functions.transforms import CenterCrop, Fused, Normalize, Resize, Scale, fuse, transform_udf

RNG = np.random.default_rng(4)


def one_by_one(steps, image):
    for s in steps:
        if isinstance(s, Resize):
            h, w = s.to(*image.shape[:2])
            image = np.einsum("yh,hwc,xw->yxc", WEIGHTS[s.mode](image.shape[0], h), image, WEIGHTS[s.mode](image.shape[1], w))
        elif isinstance(s, CenterCrop):
            size = (s.size, s.size) if isinstance(s.size, int) else s.size
            top, left = ((n - t) // 2 for n, t in zip(image.shape, size))
            image = image[top : top + size[0], left : left + size[1]]
        elif isinstance(s, Scale):
            image = image * s.factor
        elif isinstance(s, Normalize):
            image = (image - np.array(s.mean)) / np.array(s.std)
        else:
            image = s(image)
    return image


STEPS = [Resize((12, 9), "bicubic"), CenterCrop((8, 7)), Scale(), Normalize((0.5, 0.4, 0.3), (0.2, 0.3, 0.4)), Resize(10)]


@pytest.mark.parametrize("order", list(itertools.permutations(range(5)))[::17])
def test_any_order(order):
    steps = [STEPS[i] for i in order]
    for height, width in ((20, 14), (9, 31), (12, 9)):
        images = RNG.integers(0, 256, (3, height, width, 3)).astype(float)
        run = Fused([steps[:2], [steps[2:]]], 3)
        assert run.batched
        for got, image in zip(run(images), images):
            want = one_by_one(steps, image)
            assert got.shape == want.shape and np.abs(got - want).max() < 1e-6
    assert len(run.kernels) == 1


def test_one_kernel_for_a_list():
    k = fuse([Resize((4, 6)), CenterCrop(4), Scale(2.0), Normalize((1.0,), (2.0,))], 8, 6, 1)
    assert k.rows.shape == (4, 8) and k.columns.shape == (4, 6) and (k.factor, k.addend) == (1.0, -0.5)
    assert Resize(10).to(20, 31) == (10, 15) and Resize(10).to(33, 20) == (16, 10)


def test_own_steps_between():
    flip = lambda i: i[:, ::-1]
    shrink = lambda i: i[: 3 + int(i[0, 0, 0]) % 2]
    steps = [Scale(2.0), flip, Resize((6, 6)), shrink, Normalize((1.0,), (2.0,)), CenterCrop(3)]
    run = Fused(steps)
    assert not run.batched
    images = RNG.random((9, 8, 8, 1)) * 4
    for got, image in zip(run(images), images):
        assert np.abs(got - one_by_one(steps, image)).max() < 1e-9


def test_wrong_steps():
    for steps, size, what in (([CenterCrop(9)], 8, "in the middle"), ([Resize((9, 9), "area")], 8, "averaged up"), ([Resize(4, "none")], 8, "no such resizing"), ([Normalize((1.0, 2.0), (1.0, 1.0))], 8, "2 means for 3")):
        with pytest.raises(ValueError, match=what):
            fuse(steps, size, size, 3)
    with pytest.raises(ValueError, match="positive deviation"):
        Normalize((1.0,), (0.0,))
    with pytest.raises(ValueError, match="no such transform"):
        transform_udf(["resize"])


def test_column(spark):
    steps = [Resize((4, 4)), Normalize((0.5, 0.5), (0.25, 0.5))]
    images = [(i, None if i == 2 else RNG.random(2 * h * w).tolist(), h, w) for i, (h, w) in enumerate([(8, 8), (5, 6), (8, 8), (8, 8), (4, 4)])]
    df = spark.createDataFrame(images, "i int, p array<double>, h int, w int")
    for r in df.select("i", transform_udf(steps, 2)("p", "h", "w").alias("t")).collect():
        _, p, h, w = images[r.i]
        if p is None:
            assert r.t is None or r.t.pixels is None
        else:
            assert (r.t.height, r.t.width) == (4, 4) and np.abs(np.array(r.t.pixels).reshape(4, 4, 2) - one_by_one(steps, np.array(p).reshape(h, w, 2))).max() < 1e-6
    assert df.limit(0).select(transform_udf(steps, 2)("p", "h", "w")).count() == 0

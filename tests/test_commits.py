"""Commits: each vector is made once, each row is there once, whenever a run dies."""

import numpy as np
import pytest

from tesserae.functions import encoders
from tesserae.functions.registry import Encoder
from tesserae.plans.pipeline import Model, Pipeline
from tesserae.sources import artifacts, commits


def counting(path):
    """A registry of one tile encoder that notes the rows it is given, and the levels above it."""
    out = encoders.catalogue()

    def run(x):
        with open(path, "a") as f:
            f.write("x" * len(x))
        return np.stack([x.mean(1), x.std(1)], 1)

    out.register(Encoder("t", "tile", {"default": 2}, lambda: run, 4, (1, 1), (0.5,)))
    for name, level in (("s", "slide"), ("p", "patient")):
        out.register(Encoder(name, level, {"default": 2}, None, None, None, (0.5,), "fp32", "t"))
    return out


def tables(spark):
    tiles = spark.createDataFrame([(f"s{i % 3}", None, i, [float(i), i + 1.0]) for i in range(10)], "sample_id string, annotation string, tile_index int, pixels array<float>")
    return spark.createDataFrame([(f"s{i}",) for i in range(4)], "sample_id string"), tiles


@pytest.mark.parametrize("level", ["t", "s", "p"])
@pytest.mark.parametrize("save", [False, True])
def test_each_vector_is_made_once(spark, tmp_path, level, save):
    log = tmp_path / "calls"
    slides, tiles = tables(spark)
    r = Pipeline(Model.from_preset(level, registry=counting(str(log))), f"{tmp_path}/out", save_tiles=save, checkpoint=2).run(slides, tiles)
    for df in (r.tiles, r.slides, r.patients, r.status, r.skipped):
        if df is not None:
            df.collect()
    assert len(log.read_text()) == 10


@pytest.mark.parametrize("at", [0, 1])
def test_crash_and_resume(spark, tmp_path, monkeypatch, at):
    """A run dies between the payload of a batch and its commit; the next one gives each row once, and makes again what was not committed only."""
    log = tmp_path / "calls"
    slides, tiles = tables(spark)
    make = lambda: Pipeline(Model.from_preset("t", registry=counting(str(log))), f"{tmp_path}/out", resume=True, checkpoint=1)
    append, calls = commits.Table.append, []

    def dies(self, *args):
        calls.append(1)
        if len(calls) > at:
            raise RuntimeError("killed")
        return append(self, *args)

    with monkeypatch.context() as m:
        m.setattr(commits.Table, "append", dies)
        with pytest.raises(RuntimeError, match="killed"):
            make().run(slides, tiles)
    if at == 0:
        assert not artifacts.exists(spark, f"{tmp_path}/out", "tile_embeddings")
    before = len(log.read_text())
    r = make().run(slides, tiles)
    got = sorted((x.sample_id, x.tile_index, x.embedding) for x in r.tiles.collect())
    assert got == sorted((f"s{i % 3}", i, [i + 0.5, 0.5]) for i in range(10))
    assert sorted((x.sample_id, x.num_tiles) for x in artifacts.read_metadata(spark, f"{tmp_path}/out", "tile_embeddings").collect()) == [("s0", 4), ("s1", 3), ("s2", 3), ("s3", 0)]
    done = 0 if at == 0 else {1: 4}[at]
    assert len(log.read_text()) - before == 10 - done
    assert commits.Table(spark, artifacts.path_of(f"{tmp_path}/out", "tile_embeddings")).vacuum() >= 1
    assert artifacts.read(spark, f"{tmp_path}/out", "tile_embeddings").count() == 10


def test_log(spark, tmp_path):
    t = commits.Table(spark, str(tmp_path / "t"))
    rows = lambda *ids: spark.createDataFrame([(i, None if i % 2 else "c") for i in ids], "id int, annotation string")
    ids = lambda: sorted(r.id for r in t.read("p").collect())
    assert t.read("p") is None and t.entries() == []
    assert t.commit({"p": rows(1, 2)}, "a", partition_by={"p": ["annotation"]})
    assert not t.commit({"p": rows(1, 2)}, "a") and ids() == [1, 2]
    assert t.commit({"p": rows(3), "n": lambda stored: stored["p"].selectExpr("count(*) AS n")}, "b")
    assert ids() == [1, 2, 3] and t.read("n").collect()[0].n == 1
    assert {(r.id, r.annotation) for r in t.read("p").collect()} == {(1, None), (2, "c"), (3, None)}
    # A torn entry names nothing, but its number is taken; an entry of a run that is there is ignored.
    (tmp_path / "t/log/000000000002.json").write_text('{"run": "x", "repl')
    rows(9).write.parquet(str(tmp_path / "t/p/commit_=orphan"))
    t.append("b", False, {"p": ("commit_=orphan", rows(9).schema.jsonValue(), [])})
    assert ids() == [1, 2, 3] and len(list((tmp_path / "t/log").glob("*.json"))) == 4
    assert t.commit({"p": rows(7)}, "c", replaces=True) and ids() == [7]
    assert t.commit({"p": rows()}, "d") and ids() == [7]
    assert t.vacuum() == 4 and ids() == [7]


def test_two_writers_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    t = commits.Table(spark, str(tmp_path / "t"))
    (tmp_path / "t/log").mkdir(parents=True)
    fs = t.fs()

    class Late:
        """Lists the log before another writer has made its entry."""

        def __getattr__(self, name):
            return getattr(fs, name)

        def listStatus(self, path):  # noqa: N802
            return []

    t.append("a", False, {})
    monkeypatch.setattr(commits.Table, "fs", lambda self: Late())
    assert t.append("b", False, {}).number == 1
    monkeypatch.undo()
    assert [e.run for e in t.entries()] == ["a", "b"]

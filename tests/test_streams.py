"""Logs of events that grow, the sink, drained streams and snapshots of progress."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import events, logs, monitor


def line(kind, **payload):
    return json.dumps({"kind": kind, "payload": payload, "timestamp": 1}) + "\n"


def polled(follower, start):
    end = follower.latestOffset()
    return [e for p in follower.partitions(start, end) for e in follower.read(p)], end


def test_partial_lines_wait(tmp_path):
    path = tmp_path / "logs/run.jsonl"
    path.parent.mkdir()
    f = logs.Follower(str(path))
    assert polled(f, f.initialOffset()) == ([], {})
    whole = line("embedding.started", slide_count=2)
    path.write_text(whole + line("embedding.slide.started", sample_id="b", total_tiles=8)[:-20])
    got, end = polled(f, {})
    assert [e[0] for e in got] == ["embedding.started"] and got[0][1] == {"slide_count": "2"} and end == {str(path): len(whole)}
    path.write_text(whole + line("embedding.slide.started", sample_id="b", total_tiles=8))
    got, end = polled(f, end)
    assert [e[0] for e in got] == ["embedding.slide.started"]
    # An event whose newline is still missing is whole; the newline that follows is a blank line. Other ranks' files join in.
    with path.open("a") as h:
        h.write(line("x", n=None)[:-1])
    (tmp_path / "logs/run.rank3.jsonl").write_text("\n\n" + line("y", t="ü"))
    (tmp_path / "logs/run2.jsonl").write_text(line("other"))
    got, end = polled(f, end)
    assert sorted((e[0], tuple(e[1].items())) for e in got) == [("x", (("n", None),)), ("y", (("t", "ü"),))]
    with path.open("a") as h:
        h.write("\n" + line("z"))
    got, end = polled(f, end)
    assert [e[0] for e in got] == ["z"] and polled(f, end)[0] == []


@pytest.mark.parametrize("bad", ['{"kind": "a", "pay\n', "[1]\n", '{"payload": {}}\n', '{"kind": "a", "payload": 3}\n', "x\n"])
def test_a_bad_whole_line_is_an_error(tmp_path, bad):
    path = tmp_path / "run.jsonl"
    path.write_text(line("a") + bad + line("b"))
    with pytest.raises(ValueError, match=f"run.jsonl, byte {len(line('a'))}"):
        polled(logs.Follower(str(path)), {})


@pytest.mark.parametrize("part,step", [(1, 3), (7, 1000), (50, 16), (10_000, 10)])
def test_files_in_parts(tmp_path, monkeypatch, part, step):
    monkeypatch.setattr(logs, "PART", part)
    monkeypatch.setattr(logs, "STEP", step)
    path = tmp_path / "run.jsonl"
    path.write_text("".join(line("k", n="x" * (i % 40)) + "\n" * (i % 3) for i in range(60)))
    f = logs.Follower(str(path))
    first = f.latestOffset()
    got = [e for p in f.partitions({}, first) for e in f.read(p)]
    assert [len(e[1]["n"]) for e in got] == [i % 40 for i in range(60)]
    with path.open("a") as h:
        h.write(line("later"))
    assert [e[0] for p in f.partitions(first, f.latestOffset()) for e in f.read(p)] == ["later"]


def test_sink_and_source(spark, tmp_path):
    path = str(tmp_path / "worker.progress.jsonl")
    rows = lambda *ids: spark.createDataFrame([("k", {"id": str(i), "none": None}, float(i)) for i in ids], "kind string, payload map<string,string>, timestamp double")
    logs.write(rows(1, 2, 3).repartition(2), path, "cuda:1")
    logs.write(rows(4).coalesce(1), path)
    logs.write(rows(), path)
    got = {r.payload["id"]: (r.payload.get("progress_label"), r.timestamp) for r in logs.read(spark, path).collect()}
    assert got == {"1": ("cuda:1", 1.0), "2": ("cuda:1", 2.0), "3": ("cuda:1", 3.0), "4": (None, 4.0)}
    names = sorted(p.name for p in tmp_path.iterdir())
    assert all(n.startswith("worker.progress.rank") for n in names) and 2 <= len(names) <= 3
    with pytest.raises(Exception, match="boom"):
        logs.write(rows(6, 7).select("kind", F.create_map(F.lit("id"), F.when(F.col("timestamp") > 6, F.raise_error(F.lit("boom"))).otherwise("x")).alias("payload"), "timestamp").coalesce(1), path)
    assert logs.read(spark, path).count() == 4


def test_streamed_logs(spark, tmp_path):
    """A stream goes on where it was, and a streamed sink names its files by batch."""
    source, to = tmp_path / "in.jsonl", str(tmp_path / "out.jsonl")
    spark.dataSource.register(logs.EventLog)

    def once():
        q = logs.follow(spark, str(source)).writeStream.format("event_log").option("path", to).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.kind for r in logs.read(spark, to).collect())

    source.write_text(line("a") + line("b")[:-5])
    assert once() == ["a"]
    source.write_text(line("a") + line("b") + line("c"))
    assert once() == ["a", "b", "c"] and once() == ["a", "b", "c"]


def test_drain_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("kind string, n int").json(str(tmp_path / "in"))
    for mode, s in (("append", stream), ("complete", stream.groupBy("kind").agg(F.count("*").alias("m")))):
        got = events.drain(s, str(tmp_path / mode), mode)
        assert got.count() == 0 and got.columns == s.columns


def test_snapshots_in_order_of_time(spark, tmp_path):
    """Events arrive out of order, within a batch and over two of them; each change is told once, in time's order."""
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "key string, at long, id long, completed int, failed int, tiles int"

    def run():
        stream = spark.readStream.schema(schema).json(str(folder)).withColumn("ts", F.timestamp_seconds("at"))
        return sorted(tuple(r) for r in events.drain(monitor.snapshots(stream, 3, "100 seconds"), str(tmp_path / "d"), "append").selectExpr("key", "unix_seconds(ts)", "completed", "failed", "pending", "discovered_tiles").collect())

    def put(name, *rows):
        (folder / name).write_text("".join(json.dumps(dict(zip(("key", "at", "id", "completed", "failed", "tiles"), r))) + "\n" for r in rows))

    put("1", ("a", 1050, 3, 1, 0, 0), ("a", 1010, 1, 0, 0, 5), ("a", 1010, 2, 0, 0, 0), ("b", 1000, 9, 0, 1, 0), ("a", 1120, 4, 1, 0, 0))
    first = run()
    assert first == [("a", 1010, 0, 0, 3, 5), ("b", 1000, 0, 1, 2, 0)]
    put("2", ("a", 1040, 5, 0, 1, 0), ("c", 2000, 6, 1, 0, 0))
    assert run() == [("a", 1010, 0, 0, 3, 5), ("a", 1040, 0, 1, 2, 5), ("a", 1050, 1, 1, 1, 5), ("a", 1120, 2, 1, 0, 5), ("b", 1000, 0, 1, 2, 0)]


def test_monitor_counts_the_keys_of_a_bucket_apart():
    """A call takes the events of all keys of a bucket, and the state a part for each call, not for each event."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    class State:
        def __init__(self):
            self.held = []

        exists = lambda self: bool(self.held)
        get = lambda self: self.held[0] if self.single else iter(self.held)
        clear = lambda self: self.held.clear()
        appendValue = lambda self, v: self.held.append(v)  # noqa: E731, N815
        put = lambda self, vs: self.held.__setitem__(slice(None), vs)
        update = lambda self, v: self.held.__setitem__(slice(None), [v])

    waiting, last, timers = State(), State(), []
    waiting.single, last.single = False, True
    m = monitor.Monitor(40)
    m.init(SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: last, registerTimer=timers.append))
    draw = np.random.default_rng(3)
    rows = [(draw.choice(["a", "b", "c", None]), int(draw.integers(0, 40)) * 500, n, *(int(v) for v in draw.integers(0, 2, 3))) for n in range(200)]
    got = []
    for part, now in ((rows[:90], 0), (rows[90:], 7), (None, 12), (None, 30)):
        if part is not None:
            frame = pd.DataFrame(part, columns=["key", "ts", "id", "completed", "failed", "tiles"])
            list(m.handleInputRows((1,), iter([frame.assign(ts=frame["ts"].astype("datetime64[us]"))]), None))
            assert timers[-1] == min(r[1] for r in part) // 1000 + 1
        if now:
            for out in m.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None):  # noqa: B023
                got += [(None if r.key is None else str(r.key), int(r.ts.value) // 1000, r.total, r.completed, r.failed, r.pending, r.discovered_tiles) for r in out.itertuples()]
        assert len(waiting.held) <= 2
    want, counts = [], {}
    for key, us, _, *added in sorted(rows, key=lambda r: r[1:]):
        c = counts[key] = [a + b for a, b in zip(counts.get(key, [0, 0, 0]), added)]
        if any(added):
            want.append((key, us, 40, c[0], c[1], max(0, 40 - c[0] - c[1]), c[2]))
    by_key = lambda rows: sorted(rows, key=lambda r: (r[0] or "", r[1:2]))
    assert by_key(got) == by_key(want) and not waiting.held


def test_files_of_a_log_grow_in_number_with_the_table(spark, tmp_path, monkeypatch):
    """Not three tasks for one writer and two for the other, whatever the table's size."""
    from tesserae.plans import telemetry

    (tmp_path / "log").mkdir()
    folders = iter([str(tmp_path / "log"), str(tmp_path / "drained")])
    monkeypatch.setattr(telemetry.commits, "scratch", lambda _: next(folders))
    spark.range(4000, numPartitions=1).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "'click' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(telemetry, "table", lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet"))
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        got = {tuple(r) for r in telemetry.event_log_tail(spark, str(tmp_path)).select("kind", "label", "n", "ids").collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {("click", None, 2000, sum(range(0, 4000, 2))), ("click", "second", 2000, sum(range(1, 4000, 2)))}
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("run.rank")]) == 13  # with the file that is still written

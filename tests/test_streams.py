"""Live operators on small streams against what a plain loop gives."""

import datetime
from types import SimpleNamespace

import pandas as pd

from maskbench.streaming import results_stream as rs


def test_profile_counts_decisions_with_evidence_only(spark, tmp_path):
    rs.use_rocksdb(spark)
    masses = [[2.0, 0.0], [0.0, 0.0], [None, None], [None, 1.0]]
    rows = [(1, k, m) for k, m in enumerate(masses)] + [(2, 0, [0.0, 0.0])]
    d = spark.createDataFrame(rows[::-1], "inst long, k long, mass array<double>")
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    live = rs.live_profile(rs.result_stream(spark, f"{tmp_path}/in", d.schema, files_per_trigger=1), ["inst"], 2)
    rs.upsert_latest(live, f"{tmp_path}/rows", f"{tmp_path}/ck", ["inst"])
    found = {r.inst: (r.n_updates, [round(x, 12) for x in r.w]) for r in rs.latest(spark, f"{tmp_path}/rows", ["inst"]).collect()}
    w = [0.5 * 0.55 + 0.45, 0.5 * 0.55]
    w = [w[0] * 0.55, w[1] * 0.55 + 0.45]
    assert found == {1: (2, [round(x, 12) for x in w]), 2: (0, [0.5, 0.5])}


class _Value:
    """A value or a list kept between batches, counting the calls."""

    def __init__(self, calls):
        self.v, self.calls = None, calls

    def exists(self):
        self.calls.append("exists")
        return self.v is not None

    def get(self):
        self.calls.append("get")
        return [] if self.v is None else self.v

    def update(self, v):
        self.calls.append("update")
        self.v = v

    put = update

    def clear(self):
        self.calls.append("clear")
        self.v = None


class _Handle:
    def __init__(self):
        self.calls = []
        self.timers = set()

    def getValueState(self, *_):
        return _Value(self.calls)

    getListState = getValueState

    def registerTimer(self, t):
        self.calls.append("timer")
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls.append("timer")
        self.timers.discard(t)


def test_cells_and_gate_take_few_calls_whatever_the_frames(spark):
    """Three batches in shuffled order, with repeats: a handful of state calls a batch, and the plain results."""
    order = [(i * 37) % 100 for i in range(100)]
    parts = [order[:40], order[20:70], order[60:]]
    h, cells = _Handle(), rs.CompleteCells()
    cells.wait, cells.keep, cells.names = 10, 20, ["inst", "n", "jf", "complete"]
    cells.init(h)
    out = []
    for part in parts:
        pdf = pd.DataFrame({"frame": part, "score": [f / 2 for f in part], "n_frames": 100, "at": pd.Timestamp("2024-01-01")})
        out += [r for f in cells.handleInputRows((1,), iter([pdf]), None) for r in f.values.tolist()]
    assert out == [[1, 100, sum(order) / 200, 1]] and len(h.calls) < 25 and len(h.timers) == 1
    h, gate = _Handle(), rs.GateState()
    gate.names = ["inst", "frames", "events", "rejections", "longest"]
    gate.init(h)
    for part in parts:
        pdf = pd.DataFrame({"frame": part, "is_keyframe": 1, "vacuity": [float(f % 5 > 1) for f in part]})
        last = [r for f in gate.handleInputRows((1,), iter([pdf]), None) for r in f.values.tolist()]
    assert last == [[1, 100, 20, 60, 2]] and len(h.calls) < 25


def test_cells_of_a_group_share_their_state_calls(spark):
    """300 cells in three batches: a handful of calls a batch, one timer, and each cell told apart."""
    h, cells = _Handle(), rs.CompleteCells()
    cells.wait, cells.keep, cells.cell, cells.names = 10, 20, "cell", ["cell", "n", "jf", "complete"]
    cells.init(h)
    out, clock = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: 12)
    for at, frames in enumerate(([0, 1], [1, 2], [3])):
        rows = [(f"c{c}", f, c + f, 4, at) for f in frames for c in range(300) if f < 3 or c % 3]
        pdf = pd.DataFrame(rows, columns=["cell", "frame", "score", "n_frames", "ms"])
        out += [r for f in cells.handleInputRows((7,), iter([pdf[:100], pdf[100:]]), None) for r in f.values.tolist()]
    assert sorted(out) == sorted([f"c{c}", 4, c + 1.5, 1] for c in range(300) if c % 3)
    assert h.timers == {11} and len(h.calls) < 20
    stale = [r for f in cells.handleExpiredTimer((7,), clock, None) for r in f.values.tolist()]
    assert sorted(stale) == sorted([f"c{c}", 3, c + 1.0, 0] for c in range(0, 300, 3))
    assert h.timers == {22} and len(cells._load()[0]) == 200
    clock.getCurrentWatermarkInMs = lambda: 22
    assert not list(cells.handleExpiredTimer((7,), clock, None)) and cells._load() == ({}, -1) and not h.timers


def test_cells_keep_odd_keys_apart_and_time_in_any_zone(spark, tmp_path):
    """Keys come back as they were, and a cell waits as long in New York as in Greenwich."""
    keys = [("a,b", 1.5, None), ("a", None, b"\x00\xff"), (None, 0.0, b""), ('"]\n', 1e-300, b"b,"), ("", None, b"\x00")]
    at = lambda h: datetime.datetime(2024, 1, 1, 12 + h, tzinfo=datetime.timezone.utc)
    waves = [[(*k, 0, 0.5, 2, at(0)) for k in keys], [(keys[0][0], keys[0][1], keys[0][2], 0, 0.5, 2, at(2)), ("clock", 0.0, None, 0, 0.5, 1, at(2))],
             [(s, -0.0 if x == 0 else x, b, 1, 1.0, 2, at(2)) for s, x, b in keys[1:]]]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    rs.use_rocksdb(spark)
    try:
        for i, rows in enumerate(waves):
            d = spark.createDataFrame(rows, "s string, x double, b binary, frame int, score double, n_frames int, at timestamp")
            d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            live = rs.complete_cells(rs.result_stream(spark, f"{tmp_path}/in", d.schema), ["s", "x", "b"], 3 * 3_600_000, 24 * 3_600_000)
            rs.run_available(live.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/ck")
        found = [(r.s, r.x, None if r.b is None else bytes(r.b), r.n_rows, r.jf, r.complete) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(found, key=repr) == sorted([*[(*k, 2, 0.75, 1) for k in keys[1:]], ("clock", 0.0, None, 1, 0.5, 1)], key=repr)

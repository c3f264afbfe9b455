"""The incremental sweep as streams: idempotent ingest, live progress, complete cells, live gate."""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (ArrayType, BinaryType, DataType, DoubleType, FloatType, LongType, MapType, StructField, StructType,
                               TimestampType)

from ..operators.merge import duplicate_groups

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def result_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None,
                  files_per_trigger: int = 0) -> DataFrame:
    """Result files as they land in a folder."""
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Process what is there and stop; the checkpoint makes the next run continue."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


MAX_PRUNED = 10_000  # conditions of one batch above which earlier rows are not pruned


def _landed(batch: DataFrame, path: str, schema: StructType, epoch: int,
            partition: Sequence[str]) -> DataFrame:
    """Earlier rows of the conditions in the batch; a repeated epoch must not meet itself."""
    spark = batch.sparkSession
    full = StructType([*schema.fields, StructField("epoch", LongType())])
    try:
        old = spark.read.schema(full).parquet(path).where(F.col("epoch") < epoch)
        for col in partition:
            seen = batch.select(col).distinct().limit(MAX_PRUNED + 1).collect()
            if len(seen) <= MAX_PRUNED:
                named = F.col(col).isin([r[0] for r in seen if r[0] is not None])
                old = old.where(named | F.col(col).isNull() if any(r[0] is None for r in seen) else named)
        return old
    except AnalysisException:  # the folder appears with the first epoch
        return spark.createDataFrame([], full)


def ingest_results(stream: DataFrame, path: str, conflict_path: str, keys: Sequence[str],
                   values: Sequence[str], checkpoint: str, partition: Sequence[str] = ()) -> None:
    """Append each key once. Disagreeing repeats go to a side table instead of the results.

    Every epoch writes its own partition and overwrites it when repeated, so a restart after
    a lost executor or driver leaves neither gaps nor doubles. ``partition`` names condition
    columns by which the rows are laid out; only the conditions of a batch are compared.
    """
    schema = stream.schema
    keys = list(keys)

    def land(batch: DataFrame, epoch: int) -> None:
        old = _landed(batch, path, schema, epoch, partition)
        g = duplicate_groups(batch, keys, values)
        bad_keys = g.where(F.col("conflict") == 1).select(*keys)
        one = batch.join(bad_keys, keys, "left_anti").dropDuplicates(keys)
        seen = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values])
        j = one.join(seen.withColumn("_seen", F.lit(1)), keys, "left")
        differs = F.lit(False)
        for v in values:
            differs = differs | ~F.col(v).eqNullSafe(F.col(f"_o_{v}"))
        fresh = j.where(F.col("_seen").isNull()).select(*schema.names)
        clash = j.where(F.col("_seen").isNotNull() & differs).select(*schema.names)
        bad = batch.join(bad_keys, keys, "left_semi").unionByName(clash)
        fresh.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{conflict_path}/epoch={epoch}")

    run_available(stream.writeStream.foreachBatch(land), checkpoint)


def live_means(stream: DataFrame, keys: Sequence[str] = ("mode", "degradation", "level"),
               value: str = "jf") -> DataFrame:
    """Running count and mean per condition, for update mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def upsert_latest(updates: DataFrame, path: str, checkpoint: str, keys: Sequence[str],
                  every: int = 4) -> None:
    """Keep a table of the newest row per key from a stream of changed rows; ``latest`` reads it."""

    def land(batch: DataFrame, epoch: int) -> None:
        land_epoch(batch, path, epoch, keys, every)

    run_available(updates.writeStream.outputMode("update").foreachBatch(land), checkpoint)


def land_epoch(batch: DataFrame, path: str, epoch: int, keys: Sequence[str], every: int = 4) -> None:
    """Add an epoch's changed rows as a run; more than ``every`` runs are merged into one.

    The manifest of an epoch names the runs that make up the table. It is written last, from the manifest of
    an earlier epoch, so an epoch that is repeated after a lost driver gives the same table. Runs that neither of the two
    newest manifests names are deleted: a reader that holds on to an older state has to read again.
    """
    spark, folder = batch.sparkSession, _Folder(batch.sparkSession, path)
    runs = [*folder.runs(epoch - 1), f"delta-{epoch}"]
    batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/{runs[-1]}")
    if len(runs) > every:
        merged = _newest(spark.read.parquet(*[f"{path}/{r}" for r in runs]), keys)
        runs = [f"base-{epoch}"]
        merged.write.mode("overwrite").parquet(f"{path}/{runs[0]}")
    folder.commit(epoch, runs)


def _newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("v"), F.max("epoch").alias("epoch")).select(
        *keys, *[f"v.{c}" for c in rest], "epoch")


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Most recent version of every key of an upserted table."""
    runs = _Folder(spark, path).runs()
    if not runs:
        raise FileNotFoundError(f"no epoch has landed in {path}")
    return _newest(spark.read.parquet(*[f"{path}/{r}" for r in runs]), keys).drop("epoch")


class _Folder:
    """Manifests of an upserted table: one small text file per epoch, the last two of them kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self.at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.spark, self.path = spark, path

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at())] if self.fs.exists(self.at()) else []

    def epochs(self) -> list[int]:
        return sorted(int(n[9:]) for n in self.names() if n.startswith("manifest-"))

    def runs(self, upto: int | None = None) -> list[str]:
        """Runs of the newest manifest, or of the newest up to an epoch."""
        found = [e for e in self.epochs() if upto is None or e <= upto]
        return self._read(found[-1]) if found else []

    def _read(self, epoch: int) -> list[str]:
        stream = self.fs.open(self.at(f"manifest-{epoch}"))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def commit(self, epoch: int, runs: Sequence[str]) -> None:
        draft, final = self.at(f".draft-{epoch}"), self.at(f"manifest-{epoch}")
        out = self.fs.create(draft, True)
        out.write(bytearray("\n".join(runs).encode()))
        out.close()
        self.fs.delete(final, False)
        if not self.fs.rename(draft, final):
            raise OSError(f"cannot write the manifest of epoch {epoch} in {self.path}")
        kept = self.epochs()[-2:]
        alive = {r for e in kept for r in self._read(e)} | {f"manifest-{e}" for e in kept}
        for name in self.names():
            if name not in alive and name.startswith(("delta-", "base-", "manifest-")):
                self.fs.delete(self.at(name), True)


class CompleteCells(StatefulProcessor):
    """Emit an instance cell once as many distinct frames arrived as it declares, or when it is given up.

    An open cell is given up ``wait`` after its last row: then what is there is emitted with ``complete`` 0 and
    forgotten. A finished cell ignores further rows and is forgotten ``keep`` after its last row. A row that comes after its
    cell was forgotten starts it anew. Times are milliseconds of event time.

    The column ``cell`` tells the cells of a key apart; without one the key is the cell. All cells of a key are kept as one value with
    one timer, that of the cell due first, so that calls to the store, which take longer than the rows, come per key and batch.
    """

    wait = keep = 0
    cell: str | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cells", "cells binary, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        cells, timer = self._load()
        declared: dict = {}
        for pdf in rows:
            names = pdf[self.cell].tolist() if self.cell else [None] * len(pdf)
            ms = pdf["ms"] if "ms" in pdf else pdf["at"].astype("datetime64[ms]").astype("int64")
            for name, frame, score, want, at in zip(names, pdf.frame.tolist(), pdf.score.tolist(), pdf.n_frames.tolist(), ms.tolist()):
                c = cells.get(name)
                if c is None:
                    c = cells[name] = [0, 0.0, at, set()]
                seen = c[3]
                if seen is None:
                    continue
                if at > c[2]:
                    c[2] = at
                if want > declared.get(name, 0):
                    declared[name] = want
                if frame not in seen:
                    seen.add(frame)
                    c[0] += 1
                    c[1] += score
        full = [name for name, want in declared.items() if cells[name][0] >= want]
        for name in full:
            cells[name][3] = None
        self._store(cells, timer)
        if full:
            yield self._emitted(key, [(name, cells[name]) for name in full], 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cells, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        due = [(name, c) for name, c in cells.items() if self._due(c) <= now]
        for name, _ in due:
            del cells[name]
        self._store(cells, timer)
        given_up = [(name, c) for name, c in due if c[3] is not None]
        if given_up:
            yield self._emitted(key, given_up, 0)

    def _due(self, c) -> int:
        return c[2] + (self.keep if c[3] is None else self.wait)

    def _emitted(self, key, cells, complete: int) -> pd.DataFrame:
        return pd.DataFrame([[*([name] if self.cell else key), n, s / n, complete] for name, (n, s, *_) in cells], columns=self.names)

    def _load(self) -> tuple[dict, int]:
        """Count, sum, last row's time and frames seen of every cell, None for the frames of a finished one; and the timer set."""
        if not self.state.exists():
            return {}, -1
        data, timer = self.state.get()
        with pa.ipc.open_stream(data) as r:
            names, n, s, last, seen = [x.to_pylist() for x in r.read_all().columns]
        return {name: [*c, None if f is None else set(f)] for name, *c, f in zip(names, n, s, last, seen)}, timer

    def _store(self, cells: dict, old: int) -> None:
        timer = min(map(self._due, cells.values()), default=-1)
        if timer != old:
            if old >= 0:
                self.handle.deleteTimer(old)
            if timer >= 0:
                self.handle.registerTimer(timer)
        if not cells:
            self.state.clear()
            return
        n, s, last, seen = zip(*cells.values())
        table = pa.table([pa.array(list(cells)), pa.array(n), pa.array(s), pa.array(last), pa.array(
            [None if f is None else list(f) for f in seen], pa.list_(pa.int64()))], names=["cell", "n", "s", "last", "seen"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), timer))

    def close(self) -> None:
        pass


class GateState(StatefulProcessor):
    """Rejection counter in frame order. Frames that come early wait until the gap closes."""

    tau = 0.4
    max_consecutive = 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getListState("early", "frame long, flag int")
        self.gate = handle.getValueState(
            "gate", "upcoming long, consec long, events long, rejections long, longest long, waiting long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        nxt, consec, events, rejected, longest, waiting = (
            self.gate.get() if self.gate.exists() else (0, 0, 0, 0, 0, 0))
        early = dict(self.early.get()) if waiting else {}
        for pdf in rows:
            for frame, kf, score in zip(pdf.frame.tolist(), pdf.is_keyframe.tolist(), pdf.vacuity.tolist()):
                if frame >= nxt:
                    early[frame] = 2 if not kf else int(score >= self.tau)
        while nxt in early:
            flag = early.pop(nxt)
            nxt += 1
            if flag == 2:
                continue
            consec = consec + 1 if flag else 0
            rejected += flag
            longest = max(longest, consec)
            if consec >= self.max_consecutive:
                events, consec = events + 1, 0
        if early:
            self.early.put(list(early.items()))
        elif waiting:
            self.early.clear()
        self.gate.update((nxt, consec, events, rejected, longest, len(early)))
        yield pd.DataFrame([[*key, nxt, events, rejected, longest]], columns=self.names)

    def close(self) -> None:
        pass


class ProfileState(StatefulProcessor):
    """Operator profile as live state: an exponential average over decisions in frame order.

    A decision arrives as one row with the list of its operators' evidence; early decisions
    wait for the ones before them (``k`` counts decisions from 0). A decision without evidence
    is passed over: it neither moves the weights nor counts as an update.
    """

    lam = 0.45
    n_ops = 13

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getMapState("early", "k long", "mass array<double>")
        self.profile = handle.getValueState("profile", "upcoming long, updates long, w array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        nxt, n, w = self.profile.get() if self.profile.exists() else (
            0, 0, [1.0 / self.n_ops] * self.n_ops)
        for pdf in rows:
            for k, mass in zip(pdf.k, pdf.mass):
                if int(k) >= nxt:
                    # evidence that is missing is none
                    self.early.updateValue((int(k),), ([0.0 if pd.isna(x) else float(x) for x in mass],))
        while self.early.containsKey((nxt,)):
            mass = self.early.getValue((nxt,))[0]
            self.early.removeKey((nxt,))
            nxt += 1
            s = sum(mass)
            if s > 0:
                n += 1
                w = [(1 - self.lam) * a + self.lam * b / s for a, b in zip(w, mass)]
        self.profile.update((nxt, n, list(w)))
        yield pd.DataFrame([[*key, n, list(w)]], columns=self.names)

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, keys: Sequence[str], proc: StatefulProcessor, extra: str,
              mode: str) -> DataFrame:
    keyed = StructType([stream.schema[k] for k in keys])
    out = StructType([*keyed.fields, *StructType.fromDDL(extra).fields])
    proc.names = out.names
    return stream.groupBy(*keys).transformWithStateInPandas(proc, out, mode, "None")


def _as_text(col: Column, kind: DataType) -> Column:
    """A key column as text that ``_from_text`` turns back into the same value; equal keys give equal texts."""
    if isinstance(kind, (ArrayType, MapType, StructType)):
        raise TypeError(f"a key of type {kind.simpleString()} is not supported")
    if isinstance(kind, BinaryType):
        return F.base64(col)
    if isinstance(kind, TimestampType):
        return F.unix_micros(col).cast("string")
    # adding zero turns -0.0 into 0.0
    return (col + F.lit(0).cast(kind) if isinstance(kind, (DoubleType, FloatType)) else col).cast("string")


def _from_text(text: Column, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.unbase64(text)
    return F.timestamp_micros(text.cast("bigint")) if isinstance(kind, TimestampType) else text.cast(kind)


CELL_GROUPS = 512  # cells that share a hash share their state: fewer groups save calls, more keep the state of each small


def complete_cells(stream: DataFrame, keys: Sequence[str], wait_ms: int, keep_ms: int,
                   delay: str = "10 minutes") -> DataFrame:
    """Stream of instance cells (keys, n_rows, jf, complete) from rows (keys, frame, score, n_frames, at).

    ``at`` is the event time and ``delay`` how late a row may come. A cell without all its frames ``wait_ms`` after its last row is
    emitted as incomplete; a finished one is remembered for ``keep_ms``, so state does not grow with the past.
    """
    kinds = {k: stream.schema[k].dataType for k in keys}
    proc = CompleteCells()
    proc.wait, proc.keep, proc.cell = wait_ms, keep_ms, "cell"
    out = StructType.fromDDL("cell string, n_rows bigint, jf double, complete int")
    proc.names = out.names
    named = stream.withWatermark("at", delay).withColumn("cell", F.to_json(F.array(*[_as_text(F.col(k), t) for k, t in kinds.items()])))
    d = named.select(F.pmod(F.xxhash64("cell"), F.lit(CELL_GROUPS)).cast("int").alias("part"), "cell", "frame", "score", "n_frames", "at",
                     F.unix_millis("at").alias("ms"))
    d = d.groupBy("part").transformWithStateInPandas(proc, out, "Append", "EventTime")
    d = d.withColumn("cell", F.from_json("cell", "array<string>"))
    return d.select(*[_from_text(F.col("cell")[i], t).alias(k) for i, (k, t) in enumerate(kinds.items())], *out.names[1:])


def live_gate(stream: DataFrame, keys: Sequence[str], tau: float, max_consecutive: int) -> DataFrame:
    """Stream of gate counters from rows (keys, frame, is_keyframe, vacuity)."""
    proc = GateState()
    proc.tau, proc.max_consecutive = tau, max_consecutive
    return _stateful(stream, keys, proc,
                     "frames bigint, events bigint, rejections bigint, longest bigint", "Update")


def live_profile(stream: DataFrame, keys: Sequence[str], n_ops: int, lam: float = 0.45) -> DataFrame:
    """Stream of operator profiles from rows (keys, k, mass)."""
    proc = ProfileState()
    proc.n_ops, proc.lam = n_ops, lam
    return _stateful(stream, keys, proc, "n_updates bigint, w array<double>", "Update")

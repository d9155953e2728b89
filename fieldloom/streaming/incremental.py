"""Incremental versions of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldloom.operators.rom import apply_right, gram, to_matrix
from fieldloom.operators.surrogate import MAX_TRAIN, GaussianProcess, bounded_rows, expected_improvement, gp_score, top_candidates
from fieldloom.sources.scratch import Scratch


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of queries started here is kept by RocksDB, which typed state needs; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def streaming_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, mean, variance and standard error by key; for update or complete mode."""
    g = stream.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    return g.withColumn("standard_error", F.sqrt(F.col("variance") / F.col("n")))


_DMD = "run_id string, step long, late long, waiting long, re array<double>, im array<double>, operator array<double>"


#: Steps whose waiting rows share one entry of the state, and rows that are gathered before they go there.
_STEPS, _GATHER = 8192, 262_144


class _Recursion(StatefulProcessor):
    """Recursive least squares of one run; see ``streaming_dmd``.

    Waiting rows lie packed (steps, times, values) in one entry for each
    ``_STEPS`` steps, so memory holds ``_GATHER`` new rows and one entry, whatever waits.
    The model keeps ``waits``: (first time, rows) of each entry.
    """

    def __init__(self, rank: int, forgetting: float, first: int, delay: int, timed: bool):
        self.rank, self.forgetting, self.first, self.delay, self.timed = rank, forgetting, first, delay, timed
        self.kind = np.dtype([("step", "<i8"), ("at", "<i8"), ("x", "<f8", (rank,))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "operator array<double>, spread array<double>, last long, x array<double>, late long, newest long, waits array<array<long>>")
        self.waiting = handle.getMapState("waiting", "entry long", "rows binary")

    def _load(self) -> None:
        r, got = self.rank, self.model.get()
        if got is None:
            got = np.eye(r).ravel(), 1e3 * np.eye(r).ravel(), self.first - 1, None, 0, 0, []
        a, p, self.last, x, self.late, self.newest, waits = got
        self.a, self.p = np.array(a, float).reshape(r, r), np.array(p, float).reshape(r, r)
        self.x = None if x is None else np.array(x, float)
        self.waits = {int(e): (int(t), int(n)) for e, t, n in waits}

    def _read(self, entry: int) -> np.ndarray:
        return np.frombuffer(bytes(self.waiting.getValue((entry,))[0]), self.kind) if entry in self.waits else np.empty(0, self.kind)

    def _write(self, entry: int, rows: np.ndarray) -> None:
        if len(rows):
            self.waiting.updateValue((entry,), (rows.tobytes(),))
            self.waits[entry] = int(rows["at"].min()), len(rows)
        elif self.waits.pop(entry, None):
            self.waiting.removeKey((entry,))

    def _gather(self, parts: list[np.ndarray]) -> None:
        """New rows go to their entries, each in the order of steps and times."""
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["at"], rows["step"]))]
        entry = rows["step"] // _STEPS
        cuts = np.flatnonzero(np.diff(entry)) + 1
        for e, new in zip(entry[np.r_[0, cuts]].tolist(), np.split(rows, cuts)):
            old = self._read(e)
            both = np.concatenate([old, new]) if len(old) else new
            self._write(e, both[np.lexsort((both["at"], both["step"]))] if len(old) else both)

    def _release(self, until: float) -> None:
        """Take the rows that follow on the last step, and across gaps those up to the time ``until``; the rest wait in order."""
        for e in sorted(self.waits):
            rows, k = self._read(e), 0
            for step, at, x in zip(rows["step"].tolist(), rows["at"].tolist(), rows["x"]):
                if step > self.last + 1 and at > until:
                    break
                k += 1
                if step <= self.last:
                    self.late += 1
                    continue
                if self.x is not None and step == self.last + 1:
                    g = self.p @ self.x / (self.forgetting + self.x @ self.p @ self.x)
                    self.a = self.a + np.outer(x - self.a @ self.x, g)
                    self.p = (self.p - np.outer(g, self.x @ self.p)) / self.forgetting
                self.last, self.x = step, np.array(x)
            if k:
                self._write(e, rows[k:])
            if k < len(rows):
                break

    def _save(self, key, timer: bool = True) -> pd.DataFrame:
        x = None if self.x is None else self.x.tolist()
        self.model.update((self.a.ravel().tolist(), self.p.ravel().tolist(), int(self.last), x, int(self.late), int(self.newest), [[e, t, n] for e, (t, n) in self.waits.items()]))
        if self.timed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if self.timed and timer:
            self.handle.registerTimer(min(t for t, _ in self.waits.values()) + 1 if self.waits else self.newest + self.delay)
        w = np.linalg.eigvals(self.a)
        w = w[np.lexsort((w.imag, -np.abs(w)))]
        return pd.DataFrame({"run_id": [str(key[0])], "step": [int(self.last)], "late": [int(self.late)], "waiting": [self._count()], "re": [w.real.tolist()], "im": [w.imag.tolist()], "operator": [self.a.ravel().tolist()]})

    def _count(self) -> int:
        return sum(n for _, n in self.waits.values())

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        parts, held = [], 0
        for part in rows:
            new = np.empty(len(part), self.kind)
            new["step"], new["at"] = part["step"].to_numpy("int64"), part["at"].to_numpy("int64")
            if len(part):
                new["x"] = np.stack(part["x"].to_numpy())
                self.newest = max(self.newest, int(new["at"].max()))
                parts.append(new)
            held += len(part)
            if held >= _GATHER:
                self._gather(parts)
                parts, held = [], 0
        if parts:
            self._gather(parts)
        self._release(timerValues.getCurrentWatermarkInMs() if self.timed else np.inf)
        yield self._save(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        now, waited = timerValues.getCurrentWatermarkInMs(), self._count()
        self._release(now)
        over = not self.waits and now >= self.newest + self.delay
        out = self._save(key, timer=not over)
        if over:
            self.model.clear()
            self.waiting.clear()
        if self._count() < waited or not over:
            yield out

    def close(self) -> None:
        pass


def streaming_dmd(stream: DataFrame, rank: int, forgetting: float = 0.99, event_time: str | None = None, delay: str = "1 hour", first: int = 0) -> DataFrame:
    """Recursive least squares of a reduced operator by run from ``run_id, step, x`` rows; for update mode under ``rocksdb``.

    State is typed: the operator, the inverse covariance, the last step and state,
    and the rows that wait, packed by ranges of steps.  A run begins with step ``first``.
    Rows may arrive in any order: those that follow on the last step are taken at
    once; a row behind a gap waits until the gap is filled or the watermark
    (``delay`` behind the newest row) has passed the row, and is then the start of
    a new stretch.  Repeated steps and steps at or before the last one are
    counted in ``late`` and dropped.  A run's state goes once the watermark has
    passed its last row by ``delay``, so state is bounded by the runs and rows of
    that time.  Without ``event_time`` nothing waits and nothing goes.
    """
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)
    at = F.lit(0).cast("long")
    if event_time:
        stream = stream.withWatermark(event_time, delay)
        at = F.unix_millis(event_time)
    rows = stream.select(F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), F.col("x").cast("array<double>").alias("x"), at.alias("at"), *([event_time] if event_time else []))
    rows = rows.where("run_id is not null and step is not null and x is not null")
    return rows.groupBy("run_id").transformWithStateInPandas(_Recursion(rank, forgetting, first, wait, event_time is not None), _DMD, "Update", "EventTime" if event_time else "None")


class AdaptivePod:
    """A basis ``dof, mean, phi`` that grows with the snapshots of a stream.

    ``update`` is a ``foreachBatch`` function over ``dof, step, value`` rows.  Each
    snapshot of the batch, in step order, moves the mean by 1 / (k + 1) and, where
    the basis misses more than ``tol`` of it (1e-6 at least), becomes a mode (its
    normalised rest).  Means, rests and modes are combinations of the basis, the
    mean and the new snapshots, so one Gram matrix of these gives all of them: a
    batch is packed and joined once, its Gram matrix (modes and snapshots squared)
    is worked through on the driver, and one map writes the basis anew, whatever
    the number of snapshots (``TOGETHER`` at most in one round).  A second Gram
    matrix makes new modes orthonormal to full precision.  Dofs that a snapshot of
    the batch lacks leave the basis.  A batch id that was seen is skipped, so a
    repeated batch changes nothing.
    """

    TOGETHER = 256

    def __init__(self, spark: SparkSession, tol: float = 0.01, max_modes: int = 20):
        self.tmp, self.tol, self.max_modes = Scratch(spark, "adaptive"), max(tol, 1e-6), max_modes
        self.basis: DataFrame | None = None
        self.modes = self.count = 0
        self.last_batch = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return
        steps = [r.step for r in batch.select("step").distinct().sort("step").collect()]  # one row a snapshot
        for at in range(0, len(steps), self.TOGETHER):
            part = steps[at : at + self.TOGETHER]
            rows = batch if len(part) == len(steps) else batch.where(F.col("step").between(part[0], part[-1]))
            self._add(rows, len(part))
        self.last_batch = batch_id

    def _add(self, rows: DataFrame, m: int) -> None:
        value = rows.groupBy("dof", "step").agg(F.avg("value").alias("value")).groupBy("dof").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("p"))
        value = value.select("dof", F.col("p.value").alias("new")).where(F.size("new") == m)
        if self.basis is None:
            met = value.select("dof", F.concat(F.array(F.lit(0.0)), "new").alias("xs"))
        else:
            met = self.basis.join(value, "dof").select("dof", F.concat("phi", F.array("mean"), "new").alias("xs"))
        met = self.tmp.write(met, "met")
        g = to_matrix(gram(met, center=False))
        r, unit = self.modes, np.eye(len(g)) if len(g) else np.eye(self.modes + 1 + m)
        g = g if len(g) else np.zeros((len(unit), len(unit)))
        norm = lambda v: float(np.sqrt(max(v @ g @ v, 0.0)))
        mean, modes = unit[r], [unit[i] for i in range(r)]
        for s in unit[r + 1 :]:
            self.count += 1
            mean = mean + (s - mean) / self.count
            if self.count == 1:
                continue
            rest = s - mean
            for _ in range(2):
                rest = rest - sum(((v @ g @ rest) * v for v in modes), np.zeros(len(g)))
            miss = norm(rest)
            if miss > self.tol * norm(s) and len(modes) < self.max_modes:
                modes.append(rest / miss)
        self.modes = len(modes)
        new = self._written(met, np.column_stack([*modes, mean]))
        if self.modes > r:
            own = to_matrix(gram(new.select("dof", F.col("phi").alias("xs")), center=False))
            right = np.linalg.inv(np.linalg.cholesky(own)).T
            full = np.block([[right, np.zeros((self.modes, 1))], [np.zeros((1, self.modes)), np.ones((1, 1))]])
            better = self._written(new.select("dof", F.concat("phi", F.array("mean")).alias("xs")), full)
            self.tmp.drop(new)
            new = better
        self.tmp.drop(self.basis, met)
        self.basis = new

    def _written(self, packed: DataFrame, right: np.ndarray) -> DataFrame:
        k = right.shape[1] - 1
        out = apply_right(packed, right, "all", center=False).select("dof", F.col("all")[k].alias("mean"), F.slice("all", 1, k).alias("phi"))
        return self.tmp.write(out, "basis")


class ObservationLoop:
    """Next points to observe, after each batch of observations ``p, y``.

    ``update`` is a ``foreachBatch`` function: it appends the batch to a log (a
    table for each batch; none is written again) and adds its rows to the process,
    whose Cholesky factor grows by new rows alone.  From ``least`` observations on
    it takes the k candidates of the largest deviation or expected improvement,
    before that those of the smallest hashes.  The process takes the first
    ``max_train`` observations; later ones are logged.  Only a batch's rows for the
    process and the k chosen rows, in ``chosen``, reach the driver.
    """

    def __init__(self, candidates: DataFrame, k: int = 1, length: float = 1.0, least: int = 5, score: str = "uncertainty", seed: int = 0, noise: float = 1e-6, max_train: int = MAX_TRAIN):
        self.candidates, self.k, self.length, self.least, self.score, self.seed, self.noise, self.max_train = candidates, k, length, least, score, seed, noise, max_train
        self.tmp, self.chosen, self.last_batch = Scratch(candidates.sparkSession, "observe"), [], -1
        self.log: list[str] = []
        self.process: GaussianProcess | None = None
        self.count, self.best = 0, float("inf")

    @property
    def seen(self) -> DataFrame:
        """The log of all observations."""
        return self.candidates.sparkSession.read.schema("p array<double>, y double").parquet(*self.log)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return
        rows = self.tmp.write(batch.select(F.col("p").cast("array<double>").alias("p"), F.col("y").cast("double").alias("y")), "seen")
        self.log.append(rows._scratch_path)
        own = rows.where("p is not null and y is not null and not isnan(y)")
        told = own.agg(F.count("*").alias("n"), F.min("y").alias("y")).first()
        room = self.max_train - (len(self.process.x) if self.process else 0)
        if told.n:
            self.count, self.best = self.count + told.n, min(self.best, told.y)
            fresh = bounded_rows(own, room, "p", "y").toPandas().sort_values("y", kind="stable") if room else None  # max_train rows at most over all batches
            if fresh is not None and len(fresh):
                x, y = np.array(fresh.p.tolist(), float), fresh.y.to_numpy(float)
                if self.process is None:
                    self.process = GaussianProcess(x, y, self.length, self.noise)
                else:
                    self.process.grow(x, y)
        if self.count < self.least or self.process is None:
            scored = self.candidates.select("id", (-F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(1 << 40))).alias("score"))
        else:
            g = gp_score(self.candidates, self.process)
            s = F.col("std") if self.score == "uncertainty" else expected_improvement(F.col("mean"), F.col("std"), self.best)
            scored = g.select("id", s.alias("score"))
        self.chosen.append([r.id for r in top_candidates(scored, self.k).collect()])  # k rows
        self.last_batch = batch_id

"""Early stopping on a live log of metrics: a state for each run, which judges epochs in order and tells of runs that went silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The store of states, which holds them on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING, PROGRESS = ["run", "step", "at", "value"], ["run", "n", "best", "best_at", "last_step", "last_at"]


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(data).read_pandas()] if data else []


def _stopper(run: str, patience: int, silence_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Epochs wait until the watermark has passed their time; then they are judged in order, many runs in a call."""

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        waiting, progress = state.get if state.exists else (None, None)
        new = [] if state.hasTimedOut else [f.rename(columns={run: "run"})[WAITING] for f in frames]
        rows = pd.concat([*_unpacked(waiting), *new], ignore_index=True) if waiting or new else pd.DataFrame(columns=WAITING)
        known = {r[0]: r[1:] for f in _unpacked(progress) for r in zip(*[f[c].tolist() for c in PROGRESS], strict=True)}
        ready, rest = rows[rows["at"] < now].sort_values(["step", "at"], kind="stable"), rows[rows["at"] >= now]
        out = []
        for name, step, at, value in zip(*[ready[c].tolist() for c in WAITING], strict=True):
            n, best, best_at, last_step, last_at = known.get(name, (0, None, 0, None, at))
            last_at = max(last_at, at)
            if last_step is None or step > last_step:  # else repeated, or later than an epoch that was judged
                n, last_step = n + 1, step
                if best is None or best != best or value > best:  # a null, here NaN, is above nothing
                    best, best_at = value, n
                out.append((name, step, n - best_at, n - best_at >= patience, False))
            known[name] = (n, best, best_at, last_step, last_at)
        due = [int(rest["at"].min())] if len(rest) else []
        if silence_ms is not None:
            more = set(rest["run"].tolist())
            for name, (n, _, best_at, last_step, last_at) in [(k, v) for k, v in known.items() if k not in more]:
                if now > last_at + silence_ms:
                    out.append((name, last_step, n - best_at, n - best_at >= patience, True))
                    del known[name]
                else:
                    due.append(last_at + silence_ms)
        if known or len(rest):
            kept = pd.DataFrame([(k, *v) for k, v in known.items()], columns=PROGRESS)
            state.update((_packed(rest) if len(rest) else None, _packed(kept) if known else None))
            if due:
                state.setTimeoutTimestamp(max(min(due), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[run, "step", "stale", "stop", "silent"])

    return judge


def watch_runs(log: DataFrame, value: str, order: str, at: str, patience: int, run: str, late: str = "0 seconds", silence_seconds: int | None = None, groups: int = 1024) -> DataFrame:
    """A stream of epochs judged as :func:`leafgrid.operators.metrics.staleness` judges a closed log: run, order, stale, stop, silent.

    An epoch is given out when the watermark (``late`` behind the latest time ``at`` of all runs) has passed its time, so epochs
    may come in any order within that. An epoch that comes twice counts as it came first by ``at``; one that comes after a later
    one was judged is left out, as Spark leaves out what is behind the watermark. A run without an epoch for ``silence_seconds``
    gives a row with silent, its last epoch once more, and is forgotten: it starts anew if it goes on. Rows without a run, an
    order or a time are left out; a run's name is of an atomic type; a null value is an epoch that is not better. Of a run its
    waiting epochs and five numbers are kept. Runs share states by their hash, one for each of ``groups``, as a call of Python for
    each run takes longer than its epochs do; a batch writes anew the groups that it meets. A stream that goes on needs the number
    of groups with which it began.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = log.schema[run].dataType.simpleString()
    rows = log.withColumn("_time", F.col(at).cast("timestamp")).where(F.col(run).isNotNull() & F.col(order).isNotNull() & F.col("_time").isNotNull())
    rows = rows.withWatermark("_time", late).select(run, "_time", F.col(order).cast("long").alias("step"), F.unix_millis("_time").alias("at"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(run), F.lit(groups)))
    judge = _stopper(run, patience, None if silence_seconds is None else 1000 * silence_seconds)
    got = rows.groupBy("_group").applyInPandasWithState(judge, f"`{run}` {kind}, step long, stale long, stop boolean, silent boolean", "waiting binary, progress binary", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(run, F.col("step").alias(order), "stale", "stop", "silent")

"""Registries as streams: jobs that can be asked about and are forgotten without news, and answers that are remembered.

State is held per key, with a timer in event time for when it ends, so what is forgotten leaves the store of state even if
nobody asks again. Results depend on event times only, not on how rows fall into micro-batches, as long as each key's
micro-batches come in the order of time; Spark drops rows that the watermark has passed, of the same time as well. A micro-batch's rows of one key are sorted together in a task: bound them by
the source's limits of files or bytes a batch. Needs the state store that keeps timers, see `CONFIG`."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs for state with timers.
CONFIG = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

# Fixed values, in seconds: a job without news, an answer, and the answer that there is none.
PATIENCE, RESOLVED, UNRESOLVED = 600, 180 * 24 * 60 * 60, 7 * 24 * 60 * 60

_JOBS = "job string, at long, position long, status string, result double, error string, progress double"
_ANSWERS = "key string, at long, position long, outcome string, resolved boolean, fetched_at long"


def _sorted(batches: Iterator[pd.DataFrame]) -> list[dict]:
    """The rows of a key in this micro-batch, by time and position; what is missing is None."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "position"], kind="stable")
    return rows.astype(object).where(rows.notna(), None).to_dict("records")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    kinds = {"long": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}
    return out.astype({n: kinds[c.split()[1]] for n, c in zip(names, schema.split(", "))})


class _Timed(StatefulProcessor):
    """One value a key, which ends at a time."""

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", f"{self.fields}, ends long")

    def hold(self, before: tuple | None, now: tuple | None) -> None:
        if before is not None and (now is None or now[-1] != before[-1]):
            self.handle.deleteTimer(before[-1])
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
            if before is None or now[-1] != before[-1]:
                self.handle.registerTimer(now[-1])

    def close(self) -> None:
        pass


class _Jobs(_Timed):
    fields = "status string, result double, error string, progress double"

    def __init__(self, patience: int):
        self.patience = patience * 1000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        job, said = before, []
        for r in _sorted(rows):
            at = int(r["at"])
            if job is not None and at >= job[-1]:
                said.append((key[0], job[-1], None, "expired", *job[1:4]))
                job = None
            kind, ends = r["kind"], at + self.patience + 1
            if kind == "create":
                job = ("running", None, None, None, ends)
            elif kind == "poll":
                said.append((key[0], at, r["position"], *(job[:4] if job else ("missing", None, None, None))))
                job = (*job[:4], ends) if job and job[0] == "running" else None
            elif job is not None:
                status, result, error, progress = job[:4]
                if kind == "progress":
                    progress = r["number"]
                elif kind == "done":
                    status, result = "done", r["number"]
                elif kind == "error":
                    status, error = "error", r["text"]
                else:
                    continue
                job = (status, result, error, progress, ends)
        self.hold(before, job)
        yield _frame(said, _JOBS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            job = tuple(self.held.get())
            self.held.clear()
            yield _frame([(key[0], job[-1], None, "expired", *job[1:4])], _JOBS)


class _Answers(_Timed):
    fields = "resolved boolean, fetched long"

    def __init__(self, resolved: int, unresolved: int):
        self.lasts = {True: resolved * 1000, False: unresolved * 1000}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        known, said = before, []
        for r in _sorted(rows):
            at = int(r["at"])
            if known is not None and at >= known[-1]:
                known = None
            if known is not None:
                said.append((key[0], at, r["position"], "hit" if known[0] else "remembered_miss", known[0], known[1]))
            elif r["answer"] is None:
                said.append((key[0], at, r["position"], "failed", None, None))
            else:
                answer = bool(r["answer"])
                known = (answer, at, at + self.lasts[answer])
                said.append((key[0], at, r["position"], "fetched", answer, at))
        self.hold(before, known)
        yield _frame(said, _ANSWERS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield _frame([], _ANSWERS)


def _followed(rows: DataFrame, key: str, late: str, processor: StatefulProcessor, schema: str, *columns: str) -> DataFrame:
    told = rows.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    told = told.select(F.col(key).cast("string").alias(key), "ts", F.unix_millis("ts").alias("at"), F.col("position").cast("long").alias("position"), *columns)
    return told.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def polled_jobs(news: DataFrame, late: str = "0 seconds", patience: int = PATIENCE) -> DataFrame:
    """(job, at, position, status, result, error, progress): what polls are told, and jobs that expire, from
    news(job, ts, position, kind, number, text).

    `create` starts a job, `progress` replaces what it last reported, `done` gives its result and `error` its error; `poll`
    is answered, with `missing` for an unknown job. A finished job is forgotten once a poll was told; a poll of a running job
    keeps it alive. A job without news for more than `patience` seconds expires: it is reported so, a millisecond after, and
    forgotten. Times are in milliseconds. News of unknown jobs, of other kinds and without job or time are left out; rows of
    one time count in the order of their positions."""
    return _followed(news, "job", late, _Jobs(patience), _JOBS, "kind", F.col("number").cast("double").alias("number"), "text")


def cache_key(name: Column, rank: Column, language: Column) -> Column:
    """Names and ranks in lower case, and the language without its region; what isn't two letters then is English."""
    base = F.lower(F.regexp_extract(F.coalesce(language, F.lit("")), "^([A-Za-z]{2})(?:[-_]|$)", 1))
    short = F.when(base == "", "en").otherwise(base)
    return F.concat_ws("|", F.lower(F.trim(name)), F.lower(F.coalesce(rank, F.lit(""))), short)


def remembered(lookups: DataFrame, late: str = "0 seconds", resolved: int = RESOLVED, unresolved: int = UNRESOLVED) -> DataFrame:
    """(key, at, position, outcome, resolved, fetched_at): a row for each of lookups(key, ts, position, answer).

    `answer` is what asking would give at that time: whether the key is resolved, null where asking fails. An answer is
    remembered for `resolved` or `unresolved` seconds from when it was fetched, and lookups in that time are told it: `hit`
    or `remembered_miss`; otherwise they are `fetched`, or `failed`, which isn't remembered. Lookups without key or time are
    left out."""
    return _followed(lookups, "key", late, _Answers(resolved, unresolved), _ANSWERS, "answer")

"""Stateful operators on transformWithState: a guard over token streams and a request limiter, their state kept in RocksDB."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_CLOSED = re.compile(r"\[([^\[\]]*)\]")
_ID = re.compile(r"\bS([0-9]{1,12})\b")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The driver's own Python worker looks at a processor before tasks do, and has no shipped package: this module goes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
GUARDED = "answer_id long, seq long, name string, text string"
#: Keys are grouped by ranges of so many bits.
RANGE_BITS = 8
DECIDED = "user_id long, event_id long, ordinal int, allowed boolean, remaining int, reset_after long"


def cited_in(text: str) -> set[int]:
    """Ids that closed brackets of `text` cite."""
    return {int(x) for m in _CLOSED.finditer(text) for x in _ID.findall(m[1])}


def open_tail(text: str) -> str:
    """What of `text` a later token can still close: from its last open bracket on, nothing if there is none."""
    at = text.rfind("[")
    return text[at:] if at > text.rfind("]") else ""


def guard_token(tail: str, delta: str, allowed) -> tuple[str, bool]:
    """(open tail behind the token, whether a bracket that it closes cites an id that isn't allowed). `tail` is what `open_tail` left."""
    if "]" not in delta:  # nothing closes here
        return (open_tail(tail + delta) if "[" in delta else tail and tail + delta), False
    text = tail + delta
    bad = bool(cited_in(text) - {int(x) for x in allowed})
    return ("" if bad else open_tail(text)), bad


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that begin within keep their state in RocksDB."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def ranged(df: DataFrame, key: str) -> DataFrame:
    """`df` with `part`: a number for each range of 2^RANGE_BITS values of a whole-numbered key. A group then costs little for each key, and its state has that many at most."""
    return df.withColumn("part", F.shiftright(key, RANGE_BITS))


class CitationGuard(StatefulProcessor):
    """Passes each answer's tokens in the order of their numbers (0, 1, 2...), whatever order they come in, until a closed bracket cites an id that isn't allowed.

    Then it sends one `invalidated` and nothing more. A group is a range of answers (see
    `ranged`) with one row of state. Tokens that come before their turn wait in a map;
    those that come again are dropped. With `keep`, an answer that isn't touched for so
    long goes, so one that breaks off doesn't stay for ever.
    """

    def __init__(self, keep: timedelta | None = None):
        self.keep = int(keep.total_seconds() * 1000) if keep else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "answer array<long>, next array<long>, tail array<string>, tripped array<boolean>, waiting array<int>, touched array<long>", self.keep)
        self.early = handle.getMapState("early", "answer long, seq long", "delta string, allowed array<long>", self.keep)

    def _next(self, answer: int, here: dict, due: int, waiting: int) -> tuple[tuple | None, int]:
        """The token that is due, from this batch or from those that wait, and how many still wait."""
        token = here.pop(due, None)
        if waiting and self.early.containsKey((answer, due)):  # the store is asked only if something waits
            token = token or self.early.getValue((answer, due))
            self.early.removeKey((answer, due))
            waiting -= 1
        return token, waiting

    def _forget(self, answer: int) -> None:
        for k in [k for k in self.early.keys() if k[0] == answer]:
            self.early.removeKey(k)

    def _pass(self, answer: int, tokens: dict, state: tuple, out: list) -> tuple:
        """Sends what of an answer's tokens is due; its new state."""
        due, tail, tripped, waiting = state
        here = {} if tripped else {s: x for s, x in tokens.items() if s >= due}
        while not tripped:
            token, waiting = self._next(answer, here, due, waiting)
            if token is None:
                break
            tail, bad = guard_token(tail, *token)
            tripped = bad
            out.append((answer, due, "invalidated" if bad else "token", "" if bad else token[0]))
            due += 1
        if tripped:
            if waiting:
                self._forget(answer)
            return due, "", True, 0
        for s, x in here.items():
            waiting += not (waiting and self.early.containsKey((answer, s)))
            self.early.updateValue((answer, s), (x[0], [int(i) for i in x[1]]))
        return due, tail, False, waiting

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep else 0
        known = self.at.get() if self.at.exists() else None
        states = {a: (*x, t) for a, *x, t in zip(*known, strict=True)} if known else {}
        if self.keep:
            for a in [a for a, x in states.items() if x[-1] + self.keep < now]:
                del states[a]
        tokens: dict[int, dict] = {}
        for df in rows:
            ids = [0] * len(df) if pd.isna(key[0]) else df["answer_id"].tolist()  # all null ids are one answer
            for a, s, d, allowed in zip(ids, df["seq"].tolist(), df["delta"].tolist(), df["allowed"].tolist(), strict=True):
                tokens.setdefault(a, {})[s] = (d, allowed)
        out: list[tuple] = []
        for a, new in tokens.items():
            states[a] = (*self._pass(a, new, states[a][:-1] if a in states else (0, "", False, 0), out), now)
        self.at.update(tuple(map(list, zip(*((a, *x) for a, x in states.items()), strict=True))))
        found = pd.DataFrame(out, columns=["answer_id", "seq", "name", "text"])
        yield found.assign(answer_id=pd.Series([None] * len(found), dtype="Int64")) if pd.isna(key[0]) else found

    def close(self) -> None:
        pass


class FixedWindowLimiter(StatefulProcessor):
    """Decides on each request of a user by its ordinal in the fixed window: allowed up to `limit`.

    Within a batch requests count in the order of (ts, event_id). A group is a range of
    users (see `ranged`) with one row of state. A window's count is kept until the
    watermark is past the next window's end, so late ones of the window before still
    count; then a timer removes it. A group has a timer for its earliest window, which
    sets the next one.
    """

    def __init__(self, limit: int, width: int = 3600):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "start array<long>, user array<long>, n array<int>")

    def _kept(self) -> pd.DataFrame:
        start, user, n = self.counts.get() if self.counts.exists() else ([], [], [])
        return pd.DataFrame({"start": start, "user": user, "n": n}, dtype="int64")

    def _keep(self, kept: pd.DataFrame) -> None:
        self.counts.update((kept["start"].tolist(), kept["user"].tolist(), kept["n"].tolist()))

    def _gone(self, start: int) -> int:
        return (start + 2 * self.width) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        df = df[df["second"].notna()].sort_values(["at", "event_id"], kind="stable")
        second = df["second"].astype("int64")
        df = df.assign(second=second, start=second // self.width * self.width, user=0 if pd.isna(key[0]) else df["user_id"].astype("int64"))
        old, by = self._kept(), ["start", "user"]
        before = df[by].merge(old, how="left", on=by)["n"].fillna(0).astype("int64").to_numpy() if len(old) else 0
        n = df.groupby(by, sort=False).cumcount() + 1 + before
        new = pd.concat([old, df.assign(n=n)[[*by, "n"]]]).groupby(by, sort=False, as_index=False)["n"].max()
        if len(new) and (not len(old) or new["start"].min() < old["start"].min()):
            self.handle.registerTimer(self._gone(int(new["start"].min())))
        self._keep(new)
        users = pd.Series([None] * len(df), dtype="Int64", index=df.index) if pd.isna(key[0]) else df["user_id"]
        yield pd.DataFrame({"user_id": users, "event_id": df["event_id"], "ordinal": n.astype("int32"), "allowed": n <= self.limit, "remaining": (self.limit - n).clip(lower=0).astype("int32"), "reset_after": self.width - df["second"] % self.width})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self._kept()
        left = old[self._gone(old["start"]) > timerValues.getCurrentWatermarkInMs()]
        if len(left):
            self.handle.registerTimer(self._gone(int(left["start"].min())))
            self._keep(left)
        elif len(old):
            self.counts.clear()
        yield pd.DataFrame([], columns=["user_id", "event_id", "ordinal", "allowed", "remaining", "reset_after"])

    def close(self) -> None:
        pass


def guarded(tokens: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """Guarded events of a token stream (answer_id, seq, delta, allowed), which may be shuffled. Start it within `rocksdb`. Answers have whole numbers.

    `keep` is for streams without an end: state that ends by the clock makes Spark run
    batches for ever, so that a run over what is there would not come to its end.
    """
    return ranged(tokens, "answer_id").groupBy("part").transformWithStateInPandas(CitationGuard(keep), GUARDED, "Append", "ProcessingTime" if keep else "None")


def limited(events: DataFrame, limit: int, width: int = 3600) -> DataFrame:
    """Decisions on a stream of requests (user_id, event_id, ts). Start it within `rocksdb`."""
    at = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{width} seconds")
    at = at.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), F.unix_timestamp("ts").alias("second"))
    return ranged(at, "user_id").groupBy("part").transformWithStateInPandas(FixedWindowLimiter(limit, width), DECIDED, "Append", "EventTime")

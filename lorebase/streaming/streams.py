"""Structured Streaming jobs. Each runs over what is there and ends; the same plans run without an end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.cluster import shared_path, ship
from .stateful import guard_token, ranged


def write_batch(path: str):
    """For `run_to_end`: keeps each micro-batch in a folder of its own, so that one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder at `path` as a stream. As a pattern, since a stream's plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(df: DataFrame, each, mode: str = "update", progress: str | None = None) -> None:
    """Runs `each(batch, number)` on every micro-batch of what is there now; with a `progress` folder that is kept, of what came since the last time."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).option("checkpointLocation", progress or shared_path(spark, "stream-state")).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


def tumbling_counts(events: DataFrame, key: str, ts: str, width: str) -> DataFrame:
    """(window_start, key, n) over a stream, with a grace of one window for late rows."""
    kind = dict(events.dtypes)[ts]
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, width)
    counts = timed.groupBy(F.window(ts, width), F.col(key)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast(kind).alias("window_start"), key, "n")


GUARD_OUT = "answer_id long, seq long, name string, text string"


def guard_range(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Tokens pass until a closed bracket cites an id that isn't allowed; then one `invalidated`, and nothing more.

    A group is a range of answers. State: of those with an open bracket, or tripped, the
    text from the last open bracket on, and whether the guard has tripped.
    """
    tails = dict(zip(*state.get, strict=True)) if state.exists else {}  # None: tripped
    df = pd.concat([df[["answer_id", "seq", "delta", "allowed"]] for df in frames])  # the range's new tokens, which may come in any order
    df = df.sort_values(["answer_id", "seq"], kind="stable")
    ids = [0] * len(df) if pd.isna(key[0]) else df["answer_id"].tolist()  # all null ids are one answer
    rows = []
    for answer, seq, delta, allowed in zip(ids, df["seq"].tolist(), df["delta"].tolist(), df["allowed"].tolist(), strict=True):
        tail = tails.get(answer, "")
        if tail is None:
            continue
        tail, bad = guard_token(tail, delta, allowed)
        if bad or tail:
            tails[answer] = None if bad else tail
        else:
            tails.pop(answer, None)
        rows.append((answer, seq, "invalidated" if bad else "token", "" if bad else delta))
    state.update((list(tails), list(tails.values())))
    out = pd.DataFrame(rows, columns=["answer_id", "seq", "name", "text"])
    yield out.assign(answer_id=pd.Series([None] * len(out), dtype="Int64")) if pd.isna(key[0]) else out


def guard_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The same for the tokens of one answer, which `key` names."""
    return guard_range((0,), (df.assign(answer_id=key[0]) for df in frames), state)


def citation_guard(tokens: DataFrame) -> DataFrame:
    """Guarded events of a token stream (answer_id, seq, delta, allowed). Answers have whole numbers."""
    ship(tokens.sparkSession)
    return ranged(tokens, "answer_id").groupBy("part").applyInPandasWithState(guard_range, GUARD_OUT, "answer array<long>, tail array<string>", "append", GroupStateTimeout.NoTimeout)


def token_stream(answers: DataFrame, width: int = 6) -> DataFrame:
    """Answers cut to pieces of `width` characters."""
    n = F.ceil(F.length("text") / width)
    t = answers.select("answer_id", "text", "allowed", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq"))
    return t.select("answer_id", "seq", F.substring(F.col("text"), (F.col("seq") * width + 1).cast("int"), F.lit(width)).alias("delta"), "allowed")


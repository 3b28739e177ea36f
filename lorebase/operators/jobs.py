"""Jobs that write: a ledger of runs, work that is taken up where it ended, tables merged part by part, append-only logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.cluster import names_in, path_exists, put_mark, staged
from .embedding import embed
from .store import fingerprint, latest_checkpoint, upsert_latest

_NOTE = "array<struct<kind:string,detail:string>>"
LEDGER = f"run_id string, seq int, command string, source string, started_at timestamp, finished_at timestamp, counts map<string,bigint>, warnings {_NOTE}, errors {_NOTE}, status string"


class Run:
    """One run of a job, while it lasts."""

    def __init__(self, run_id: str):
        self.run_id = run_id
        self.warnings: list[tuple[str, str]] = []
        self.errors: list[tuple[str, str]] = []
        self.counts: dict[str, int] = {}
        self._watched: list[tuple[str, Observation]] = []

    def warn(self, kind: str, detail: str) -> None:
        self.warnings.append((kind, detail))

    def error(self, kind: str, detail: str) -> None:
        """What went wrong for a part of the work; the run then ends as `partial`."""
        self.errors.append((kind, detail))

    def counted(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, whose rows are counted while a job of the run writes it, without a job of their own. It has to be written, whole, before the run ends."""
        seen = Observation(f"{name}-{uuid4().hex[:8]}")
        self._watched.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def _gather(self) -> None:
        for name, seen in self._watched:
            self.counts[name] = self.counts.get(name, 0) + seen.get["n"]


class Ledger:
    """Rows of runs at `path`: one with status `running` when a run begins, one with its end. Rows are only ever appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _put(self, run: Run, seq: int, command: str, source: str, started: datetime, status: str) -> None:
        now = None if seq == 0 else datetime.now(UTC)
        row = (run.run_id, seq, command, source, started, now, run.counts, run.warnings, run.errors, status)
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def run(self, command: str, source: str = "") -> Iterator[Run]:
        """`with ledger.run("index") as run: ...`. Ends as `succeeded`; as `partial` if the run noted errors; as `failed`, with the error, if one is raised, which goes on."""
        run, started = Run(uuid4().hex), datetime.now(UTC)
        self._put(run, 0, command, source, started, "running")
        try:
            yield run
            run._gather()
        except BaseException as e:
            run.errors.append((type(e).__name__, str(e)[:1000]))
            self._put(run, 1, command, source, started, "failed")
            raise
        self._put(run, 1, command, source, started, "partial" if run.errors else "succeeded")

    def rows(self) -> DataFrame:
        """The last row of each run; a run that the driver didn't outlive stays `running`."""
        rows = self.spark.read.schema(LEDGER).parquet(self.path) if path_exists(self.spark, self.path) else self.spark.createDataFrame([], LEDGER)
        whole = F.struct(*rows.columns)
        return rows.groupBy("run_id").agg(F.max_by(whole, "seq").alias("r")).select("r.*")


def pending(chunks: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Rows with a text that have no vector at `path` yet."""
    spark, wanted = chunks.sparkSession, chunks.where("text IS NOT NULL")
    return wanted.join(spark.read.parquet(path).select(key), key, "left_anti") if path_exists(spark, path) else wanted


def embed_pending(chunks: DataFrame, path: str, load: Callable, dim: int, *, batch_rows: int = 100_000, key: str = "id") -> int:
    """Embeds what has no vector at `path` (`key`, vector) in ranges of the key of about `batch_rows` rows, each appended when it is done; the number of ranges.

    A run that is stopped leaves whole rows only, and the next one embeds only the rest; a
    run that finds nothing writes nothing. The key is a distinct whole number.
    """
    waiting = pending(chunks, path, key).select(key, "text")
    n, high = waiting.agg(F.count("*"), F.max(key)).first()
    if n == 0:
        return 0
    parts = -(-n // batch_rows)
    cuts = sorted({int(c) for c in waiting.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts)} | {high}) if parts > 1 else [high]
    low = None
    for cut in cuts:
        inside = F.col(key) <= cut if low is None else (F.col(key) > low) & (F.col(key) <= cut)
        embed(pending(chunks.where(inside), path, key), load, dim, keys=(key,)).write.mode("append").parquet(path)
        low = cut
    return len(cuts)


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str, parts: int = 64) -> dict[str, int]:
    """Upserts `new` into the table at `path`, the highest `version` of a key wins; {inserted, updated, unchanged, parts}: keys, and parts written.

    The table is cut into parts by a hash of the keys, so that a key never moves. Only
    parts with a key that is new or has changed are written again, by overwriting those
    partitions alone; the files of the others stay as they are, and so do all files if
    nothing has changed. The number of parts is kept with the table. An older version, or
    the same row again, changes nothing; of repeated keys in `new` the highest version
    counts. Where the catalog has a table format with MERGE, that is the better way.
    """
    kept = [x for x in names_in(spark, path) if x.startswith("_parts=")]
    parts = int(kept[0].split("=")[1]) if kept else parts
    columns = new.columns
    rows = staged(upsert_latest(new.limit(0), new, keys, version).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "merge")
    if not kept:
        rows.repartition("_part").write.partitionBy("_part").mode("append").parquet(path)
        put_mark(spark, f"{path}/_parts={parts}")
        return {"inserted": rows.count(), "updated": 0, "unchanged": 0, "parts": rows.select("_part").distinct().count()}
    old = spark.read.schema(rows.schema).parquet(path)
    mine = [r[0] for r in rows.select("_part").distinct().collect()]  # at most `parts`
    seen = old.where(F.col("_part").isin(mine)).select(*keys, fingerprint(columns).alias("_old"), F.col(version).alias("_old_version"))
    met = rows.select(*keys, "_part", fingerprint(columns).alias("_new"), F.col(version).alias("_version")).join(seen, keys, "left")
    newer = F.col("_old_version").isNull() | (F.col("_version") >= F.col("_old_version"))
    kind = F.when(F.col("_old").isNull(), "inserted").when((F.col("_old") != F.col("_new")) & newer, "updated").otherwise("unchanged")
    told = met.groupBy("_part", kind.alias("kind")).agg(F.count("*").alias("n")).collect()  # three rows a part at most
    touched = sorted({r["_part"] for r in told if r["kind"] != "unchanged"})
    if touched:
        here = F.col("_part").isin(touched)
        merged = upsert_latest(old.where(here).select(*columns, "_part"), rows.where(here).select(*columns, "_part"), keys, version)
        staged(merged, "merged").repartition("_part").write.partitionBy("_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return {k: sum(r["n"] for r in told if r["kind"] == k) for k in ("inserted", "updated", "unchanged")} | {"parts": len(touched)}


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_part")


def append_new(new: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows of `new` whose keys the table at `path` lacks, one for each key; how many."""
    spark = new.sparkSession
    rows = new.dropDuplicates(keys)
    if path_exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows = staged(rows, "append")  # counted and written from one result
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


#: The columns that an ask log may have: none tells who asked.
ASK_LOG = "question string, lang string, rewritten_question string, retrieved_section_ids array<bigint>, top_score double, answered boolean, abstained boolean, citation_violation boolean, model string, tokens_in int, tokens_out int, latency_ms int, created_at timestamp"


def append_ask_log(rows: DataFrame, path: str) -> None:
    """Appends the log's columns of `rows`, by day; others are left out, absent ones are null, and `created_at` is the present where it is absent or null."""
    kinds = [x.rsplit(" ", 1) for x in ASK_LOG.split(", ")]
    taken = {c.lower() for c in rows.columns}
    cast = [(F.col(name) if name in taken else F.lit(None)).cast(kind).alias(name) for name, kind in kinds]
    out = rows.select(*cast).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    out.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Appends each row as a line of JSON."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last well-formed line of each key over the text files under `path`: later files (by time, then name) before earlier ones, later lines before earlier ones. Blank lines, malformed ones and a cut-off tail are skipped; large files are read in blocks."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line_no"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), at.alias("at"))
    return latest_checkpoint(lines, schema, key, "at")

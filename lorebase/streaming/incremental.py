"""An index that grows with a stream of sections: their references, links, chunks and vectors follow in the same micro-batch.

Every table keeps the rows of a batch in a folder of its own, and an empty mark under
`commits`, put last, makes all of a batch's folders visible at once. A batch that fails
halfway is never seen, and when it is run again it replaces itself; one that was
committed before adds only sections that no batch has, so nothing comes twice and
nothing is lost, whatever number a stream gives it.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_no
from ..operators.chunking import CEILING, chunk_sections
from ..operators.embedding import embed, hashing_model
from ..operators.graph import expanded, extract_references, resolve_titles
from ..sources.cluster import drop_path, names_in, put_mark, ship

SCHEMAS = {
    "sections": "id long, statute_id long, section_no string, heading string, text string",
    "references": "id long, pos int, no string, raw string, target long, key string",
    "links": "from_section_id long, to_section_id long, raw_text string",
    "chunks": "id long, chunk_idx int, text string, token_count int",
    "vectors": "id long, chunk_idx int, vector array<double>",
}


class IncrementalIndex:
    """The index at `path`, a folder that the cluster shares. statutes: id, short_title, which references may name.

    `load` makes a model of texts to vectors of `dim` numbers, once in each task.
    """

    def __init__(self, spark: SparkSession, path: str, statutes: DataFrame, *, load: Callable | None = None, dim: int = 64, ceiling: int = CEILING):
        ship(spark)
        self.spark, self.path, self.statutes = spark, path, statutes
        self.load, self.dim, self.ceiling = load or hashing_model(dim), dim, ceiling

    def committed(self) -> list[str]:
        """Keys of the batches that are visible: a name for each batch, so few."""
        return names_in(self.spark, f"{self.path}/commits")

    def table(self, name: str, keys: list[str] | None = None) -> DataFrame:
        """Rows of the committed batches, or of `keys`."""
        keys = self.committed() if keys is None else keys
        if not keys:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{name}/{k}" for k in keys))

    def _write(self, name: str, key: str, rows: DataFrame) -> DataFrame:
        columns = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/{key}")
        return self.table(name, [key])

    def add(self, batch: DataFrame, key: str) -> bool:
        """Index the sections of `batch` (as SCHEMAS has them) that no committed batch holds; False if there are none.

        Repeated ids in one batch: one row stays. References of the new sections meet all
        sections, and references of earlier ones meet the new sections.
        """
        done = self.committed()
        if key in done:
            key = f"{key}.{uuid4().hex[:8]}"
        low, high = batch.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return False
        known = self.table("sections", done).where(F.col("id").between(low, high)).select("id")  # files' statistics leave most out
        new = self._write("sections", key, batch.where("id IS NOT NULL").dropDuplicates(["id"]).join(known, "id", "left_anti"))
        if new.isEmpty():
            drop_path(self.spark, f"{self.path}/sections/{key}")
            return False
        refs = self._write("references", key, self._references(new))
        self._write("links", key, self._links(refs, new, done))
        chunks = self._write("chunks", key, chunk_sections(new.select("id", "heading", "text"), self.ceiling))
        self._write("vectors", key, embed(chunks, self.load, self.dim, keys=("id", "chunk_idx")))
        put_mark(self.spark, f"{self.path}/commits/{key}")
        return True

    def _references(self, sections: DataFrame) -> DataFrame:
        """A row for each number of each reference to a known act; `target` is the act."""
        refs = extract_references(sections.select("id", "statute_id", "text")).where("kind = 'section'")
        named = resolve_titles(refs, self.statutes).withColumnRenamed("statute_id", "named")
        refs = refs.join(named, refs.act == named.phrase, "left").withColumn("target", F.when(F.col("act").isNull(), F.col("statute_id")).otherwise(F.col("named")))
        each = refs.where("target IS NOT NULL").withColumn("no", F.explode(expanded(F.col("numbers"))))
        return each.withColumn("key", normalise_no(F.col("no")))

    def _links(self, refs: DataFrame, new: DataFrame, done: list[str]) -> DataFrame:
        places = lambda s: s.select(F.col("statute_id").alias("target"), normalise_no(F.col("section_no")).alias("key"), F.col("id").alias("to_id")).groupBy("target", "key").agg(F.min("to_id").alias("to_id"))
        old = self.table("sections", done)
        met = refs.join(places(old.unionByName(new)), ["target", "key"]).unionByName(self.table("references", done).join(places(new), ["target", "key"]))
        edges = met.where("to_id <> id").groupBy(F.col("id").alias("from_section_id"), F.col("to_id").alias("to_section_id")).agg(F.max_by("raw", F.struct("pos", "no")).alias("raw_text"))
        return edges.join(self.table("links", done), ["from_section_id", "to_section_id"], "left_anti")

    def follow(self, stream: DataFrame, run: str) -> None:
        """Index what a stream of sections holds now. Its progress is kept beside the tables, one for each `run`, so that the next call goes on where this one ended."""

        def each(batch: DataFrame, number: int) -> None:
            batch = batch.persist()  # asked for its ids, then for its rows
            self.add(batch, f"{run}-{number}")
            batch.unpersist()

        q = stream.writeStream.option("checkpointLocation", f"{self.path}/_progress/{run}").foreachBatch(each).trigger(availableNow=True).start()
        q.awaitTermination()

    def compact(self) -> None:
        """All committed batches as one. Readers see the old ones until the marks change; a stop between leaves only rows that are there twice, which the next compaction removes."""
        keys = self.committed()
        if len(keys) < 2:
            return
        key = f"all-{uuid4().hex[:12]}"
        unique = {"sections": ["id"], "references": ["id", "pos", "no"], "links": ["from_section_id", "to_section_id"], "chunks": ["id", "chunk_idx"], "vectors": ["id", "chunk_idx"]}
        for name in SCHEMAS:
            self._write(name, key, self.table(name, keys).dropDuplicates(unique[name]))
        put_mark(self.spark, f"{self.path}/commits/{key}")
        for k in keys:
            drop_path(self.spark, f"{self.path}/commits/{k}")
            for name in SCHEMAS:
                drop_path(self.spark, f"{self.path}/{name}/{k}")


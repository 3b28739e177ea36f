"""Balanced label propagation over linked documents, on DataFrame functions only.

Links are memberships: documents that share a key are linked with one another, and a
group of any size is as many rows as it has members. Each round counts every group's
members by shard, names the shard where most of them are as its target, and moves
members there as far as the shard's quota lets linked documents in. Last, shards over
their quota give up documents, those without links first, until counts are level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of one cell of a numbering; each cell is one window's partition.
CELL = 4096


def _cells(n: int) -> int:
    return max(64, -(-n // (16 * CELL)))


def numbered(df: DataFrame, keys: list[str], out: str, cells: int, order: list[Column], cell: Column | None = None) -> DataFrame:
    """`out`: a gapless number from 0 within each `keys`, without bringing a key's rows together.

    Rows of a key are dealt to `cells` cells by `cell` (a hash of the order's columns
    unless given); the number is the rows of the cells before plus the place in the own
    cell. Rows keep the order of cells, and within one that of `order`.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)) if cell is None else cell
    df = df.withColumn("_cell", cell)
    sizes = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = df.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(*order)) - 1)
    return placed.join(sizes, [*keys, "_cell"]).withColumn(out, F.col("_before") + F.col("_at")).drop("_cell", "_before", "_at")


def propagate(nodes: DataFrame, links: DataFrame, *, shards: int = 16, slack: float = 0.25) -> DataFrame:
    """(row, shard, slot) for each of `nodes` (row: long, unique): counts of shards differ by one at most.

    Rounds go on until no row moves, or until a round gathers no more members at their
    groups' targets; so they end, as that number only rises.

    `links` (row, key): rows with equal keys are linked; null keys and keys of one row
    link nothing. The start deals rows out by number, so that it is level; groups larger
    than a shard fill theirs up to the quota and stay spread beyond it. Slots are gapless
    from 0. Without links the start remains; no nodes give no rows.
    """
    n = nodes.count()
    cells = _cells(n)
    quota = F.lit(n // shards) + F.when(F.col("shard") < n % shards, 1).otherwise(0)
    start = _dealt(nodes, shards, cells)
    groups = links.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # `grp` keeps a group together where rows queue; a group of more than a cell goes in parts.
    salt = F.when(F.col("size") > CELL, F.shiftright(F.xxhash64("row"), 52)).otherwise(0)
    linked = checkpoint(links.distinct().join(groups, "key").select("row", "key", F.xxhash64("key", salt).alias("grp")))
    at = checkpoint(start.join(linked.groupBy("row").agg(F.min("grp").alias("grp")), "row", "left"))
    if not linked.isEmpty():
        tally, gathered = _tally(at, linked)
        while True:
            moves = _round(at, linked, tally, n, shards, slack, cells)
            if moves.isEmpty():
                break
            moved = checkpoint(at.join(moves, "row", "left").select("row", F.coalesce("to", "shard").alias("shard"), "grp"))
            tally, now = _tally(moved, linked)
            if now <= gathered:
                break
            at, gathered = moved, now
    return _levelled(at, quota, shards, cells)


def _dealt(nodes: DataFrame, shards: int, cells: int) -> DataFrame:
    """Level start: rows of each cell of a hash are numbered on from where the cells before end, and dealt in turn."""
    df = nodes.select("row").withColumn("all", F.lit(0))
    return numbered(df, ["all"], "i", cells * shards, [F.col("row")]).select("row", F.pmod("i", F.lit(shards)).cast("int").alias("shard"))


def _tally(at: DataFrame, linked: DataFrame) -> tuple[DataFrame, int]:
    """(key, shard, votes), and how many members stand where most of their group does."""
    tally = checkpoint(linked.join(at.select("row", "shard"), "row").groupBy("key", "shard").agg(F.count("*").alias("votes")))
    most = tally.groupBy("key").agg(F.max("votes").alias("votes"))
    return tally, most.agg(F.coalesce(F.sum("votes"), F.lit(0))).first()[0]


def _round(at: DataFrame, linked: DataFrame, tally: DataFrame, n: int, shards: int, slack: float, cells: int) -> DataFrame:
    """(row, to): the members that move to their groups' targets in this round."""
    # Rows linked by several keys go to the key whose target has most votes.
    best = tally.groupBy("key").agg(F.max(F.struct(F.col("votes"), F.xxhash64("key", "shard").alias("tie"), F.col("shard").alias("to"))).alias("b"))
    wish = linked.join(best.select("key", "b.votes", "b.to"), "key").groupBy("row").agg(F.max(F.struct("votes", "to", "grp")).alias("w"))
    wish = wish.join(at.select("row", "shard"), "row").select("row", "shard", "w.to", "w.grp").where("shard <> to")
    held = at.groupBy("shard").agg(F.count("grp").alias("held"))
    rooms = F.floor(F.lit(n / shards * (1 + slack))).cast("long")
    room = at.sparkSession.range(shards).select(F.col("id").cast("int").alias("to")).join(held.withColumnRenamed("shard", "to"), "to", "left").select("to", F.greatest(rooms - F.coalesce("held", F.lit(0)), F.lit(0)).alias("room"))
    # Members of a group stand together in the queue of their target, so that whole groups are let in.
    queued = numbered(wish, ["to"], "i", cells, [F.col("grp"), F.col("row")], F.pmod("grp", F.lit(cells)))
    return checkpoint(queued.join(F.broadcast(room), "to").where("i < room").select("row", "to"))


def _levelled(at: DataFrame, quota: Column, shards: int, cells: int) -> DataFrame:
    """Rows of shards over their quota go to those below it: unlinked rows first, as few as it takes."""
    cell = F.when(F.col("grp").isNull(), cells + F.pmod(F.xxhash64("row", F.lit(3)), F.lit(cells))).otherwise(F.pmod("grp", F.lit(cells)))
    # Linked rows come first and so stay, group by group; those numbered beyond the quota leave.
    seated = checkpoint(numbered(at, ["shard"], "i", cells, [F.col("grp"), F.col("row")], cell))
    over = seated.where(F.col("i") >= quota)
    held = at.groupBy("shard").agg(F.count("*").alias("n"))
    spare = at.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left").select("shard", F.greatest(quota - F.coalesce("n", F.lit(0)), F.lit(0)).alias("spare"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are shards
    spare = spare.select(F.col("shard").alias("to"), F.coalesce(F.sum("spare").over(before), F.lit(0)).alias("lo"), "spare").where("spare > 0")
    movers = numbered(over.select("row").withColumn("all", F.lit(0)), ["all"], "j", cells, [F.col("row")])
    moved = movers.join(F.broadcast(spare), (F.col("j") >= F.col("lo")) & (F.col("j") < F.col("lo") + F.col("spare")))
    moved = moved.select("row", F.col("to").alias("shard"), (F.col("j") - F.col("lo")).alias("k"))
    # A shard that takes rows had fewer than its quota, so its own end where the new ones begin.
    moved = moved.join(F.broadcast(held), "shard", "left").select("row", "shard", (F.coalesce("n", F.lit(0)) + F.col("k")).alias("slot"))
    return seated.where(F.col("i") < quota).select("row", "shard", F.col("i").alias("slot")).unionByName(moved)


def shard_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, slack: float = 0.25) -> DataFrame:
    """One row for each row of `documents`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts (by SHA-256) are linked. Counts of shards differ by one
    at most (law `rows`); grown_shard is null. Size is the UTF-8 bytes of the text, none
    if it is null, plus 1; null texts are linked with nothing, empty ones with one
    another. Ids are only carried, so they may repeat or be null; other columns are
    ignored and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    rows = checkpoint(rows)
    placed = propagate(rows.select("row"), rows.select("row", "key"), shards=shards, slack=slack)
    return rows.join(placed, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(placed: DataFrame, key: str = "key", shard: str = "shard") -> DataFrame:
    """One row: groups, and the groups' parts beyond the first (0 if every group stands in one shard)."""
    parts = placed.where(F.col(key).isNotNull()).groupBy(key, shard).agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("parts"), F.sum("n").alias("n")).where("n > 1")
    return parts.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("cuts"))

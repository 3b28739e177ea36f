"""Keeping tables current: upserts, insert-ignore, change detection, ledgers, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables' rows, the highest `version` of each key only. Equal versions: the new row."""
    whole = F.struct(*existing.columns).alias("row")
    rows = existing.select(*keys, whole, F.lit(0).alias("new")).unionByName(new.select(*keys, whole, F.lit(1).alias("new")))
    latest = F.max_by("row", F.struct(F.col("row")[version].isNotNull(), F.col("row")[version], "new"))  # partly done before the shuffle
    return rows.groupBy(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).agg(latest.alias("row")).select("row.*")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` to append: one for each key that `existing` lacks."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def changed_rows(existing: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of new rows whose fingerprint isn't stored, with it."""
    old = existing.select(key, fingerprint(columns).alias("sha"))
    return new.select(key, fingerprint(columns).alias("sha")).join(old, [key, "sha"], "left_anti")


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of all values, each behind its length so that no two rows look alike; null is told apart."""
    parts = (F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in columns)
    return F.sha2(F.concat(*parts), 256)


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows that came, went or changed; fingerprints are of 32 hex characters."""
    f = F.substring(fingerprint(columns), 1, 32)
    a, b = old.select(key, f.alias("a")), new.select(key, f.alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def scoped_rebuild(existing: DataFrame, rebuilt: DataFrame, scope: Column) -> DataFrame:
    """`existing` with the rows in `scope` replaced by the rebuilt ones in it."""
    return existing.where(~scope).unionByName(rebuilt.where(scope))


def latest_checkpoint(lines: DataFrame, schema: str, key: str, order: str, raw: str = "line") -> DataFrame:
    """The last well-formed line of each key; blank and malformed lines are skipped."""
    parsed = lines.where(F.trim(raw) != "").select(order, F.from_json(raw, schema).alias("r")).where(f"r.{key} IS NOT NULL")
    return parsed.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", order).alias("r")).select("r.*")


def cascade_delete(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Children and grandchildren that stay when the parents of `gone` go. Columns: parents.id, children.id and .parent_id, grandchildren.parent_id."""
    left = children.join(parents.where(gone).select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    lost = children.join(left.select("id"), "id", "left_anti").select(F.col("id").alias("parent_id"))
    return left, grandchildren.join(lost, "parent_id", "left_anti")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")

"""Copies hidden by formatting: exact hot-key detection, salted two-level aggregation, one-level shuffle for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Letters and digits only, letter case removed (through upper case, so that variants of one letter meet)."""
    return F.regexp_replace(F.lower(F.upper(text)), _OTHER, "")


def canonical_unordered(text: Column) -> Column:
    """As canonical, the words (runs of letters and digits) sorted."""
    return F.array_join(F.array_sort(F.split(F.lower(F.upper(text)), _OTHER)), "")


def canonical_key(ordered: Sequence[str], unordered: Sequence[str]) -> Column:
    """128-bit key of the canonical fields; null differs from empty, and the separator can't occur in a canonical field."""
    parts = [canonical(F.col(c)) for c in ordered] + [canonical_unordered(F.col(c)) for c in unordered]
    return F.unhex(F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("~")) for p in parts])))


class CopyGroups:
    """The copy groups of a table.

    keyed: (id, key), one narrow row per row that may have copies, kept in the shared checkpoint folder so that the
    texts are read once. hot: the keys with at least `threshold` rows, found exactly from partial counts summed per key;
    there are at most max_hot of them whatever the data, because threshold >= rows / max_hot, so they may be broadcast.
    """

    def __init__(self, df: DataFrame, *, row_id: str, ordered: Sequence[str], unordered: Sequence[str] = (), required: Sequence[str] = (), max_hot: int = 4096, least_hot: int = 10_000, salts: int = 64):
        may = df
        for c in required:
            may = may.where(F.col(c).isNotNull())
        self.keyed = cut_lineage(may.select(F.col(row_id).cast("long").alias("id"), canonical_key(ordered, unordered).alias("key")).where("id IS NOT NULL"))
        self.threshold = max(least_hot, -(-self.keyed.count() // max_hot))
        counts = self.keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        self.hot = counts.where(F.col("n") >= self.threshold).select("key")
        self.salts = salts

    def _hot_rows(self) -> DataFrame:
        return self.keyed.join(F.broadcast(self.hot), "key")

    def _other_rows(self) -> DataFrame:
        return self.keyed.join(F.broadcast(self.hot), "key", "left_anti")

    def _hot_groups(self) -> DataFrame:
        salted = self._hot_rows().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(self.salts)).cast("int"))
        level1 = salted.groupBy("key", "salt").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        return level1.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))

    def groups(self) -> DataFrame:
        """(first_id, copies) of every group, groups of one included."""
        rest = self._other_rows().groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        return self._hot_groups().unionByName(rest).select("first_id", "copies")

    def copies(self) -> DataFrame:
        """(first_id, copy_id) of every row that is not its group's representative."""
        hot = self._hot_rows().join(F.broadcast(self._hot_groups().select("key", "first_id")), "key")
        rest = self._other_rows().withColumn("first_id", F.min("id").over(Window.partitionBy("key")))
        both = hot.select("first_id", "id").unionByName(rest.select("first_id", "id"))
        return both.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def find_copies(df: DataFrame, *, row_id: str, ordered: Sequence[str], unordered: Sequence[str] = (), required: Sequence[str] = (), **tuning: int) -> DataFrame:
    """(first_id, copy_id): each copy with the smallest id of its group.

    Rows are copies when every field in ordered is equal but for letter case and all but letters and digits, and every
    field in unordered also but for the order of its words. Rows with a null in a required field are never copies; a
    null in another field equals only a null. Rows with a null id are left out. An empty table gives an empty result.
    """
    return CopyGroups(df, row_id=row_id, ordered=ordered, unordered=unordered, required=required, **tuning).copies()


def collapse_copies(df: DataFrame, *, row_id: str, ordered: Sequence[str], unordered: Sequence[str] = (), required: Sequence[str] = (), keep: Sequence[str] = (), count_as: str = "copies", **tuning: int) -> DataFrame:
    """(row_id, *keep, copies): one row per record, the one with the smallest id, and how many copies it had, itself included.

    Rows that are never copies (see find_copies) stay with a count of 1.
    """
    groups = CopyGroups(df, row_id=row_id, ordered=ordered, unordered=unordered, required=required, **tuning).groups()
    rows = df.select(F.col(row_id).cast("long").alias("__id"), *[F.col(c) for c in keep], F.lit(True).alias("__may") if not required else (F.greatest(*[F.col(c).isNull() for c in required], F.lit(False)) == F.lit(False)).alias("__may"))
    kept = rows.where("__may").join(groups, F.col("__id") == F.col("first_id")).drop("first_id")
    alone = rows.where("NOT __may").withColumn("copies", F.lit(1).cast("long"))
    return kept.unionByName(alone).select(F.col("__id").alias(row_id), *keep, F.col("copies").alias(count_as))

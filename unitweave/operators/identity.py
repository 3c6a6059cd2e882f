"""Identity of content as a tree of hashes: the same for the same rows, however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.operators import scan
from unitweave.sources.work import settle

#: Nodes that one hash is made of.
FAN = 1024


def hashed(*values: Column) -> Column:
    """sha-256 of values with their sizes, so that no two lists of values look alike; null is apart from an empty text."""
    written = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written]), 256)


def tree_digests(leaves: DataFrame, key: str, place: str, leaf: str, fan: int = FAN) -> DataFrame:
    """key, digest: the root over each key's leaves, by their place (an integer from 0).

    `fan` places next to each other are hashed with their places to one node, nodes likewise, until
    a key has one; so no task holds more than `fan` of a key's hashes, and a change
    of one leaf changes its own way up only. Leaves of one place are taken in their own order.
    """
    level, most = leaves.select(F.col(key).alias("key"), F.col(place).cast("long").alias("place"), F.col(leaf).alias("digest")), None
    while most is None or most > 0:
        here = F.transform(F.array_sort(F.collect_list(F.struct(F.col("place") % fan, "digest"))), lambda x: F.concat_ws(":", x["col1"].cast("string"), x["digest"]))
        level = level.groupBy("key", F.call_function("div", F.col("place"), F.lit(fan)).alias("above")).agg(F.sha2(F.array_join(here, ";"), 256).alias("digest")).select("key", F.col("above").alias("place"), "digest")
        level = settle(level, "digests")  # a row for `fan` of those before
        most = level.agg(F.max("place")).first()[0] or 0
    return level.select(F.col("key").alias(key), "digest")


def content_digest(rows: DataFrame, key: str, place: str, *values: str) -> str:
    """One digest of all rows: of each key's values by place, and of the keys in order."""
    leaves = rows.select(F.col(key).alias("key"), F.col(place).alias("place"), hashed(*[F.col(v) for v in (key, place, *values)]).alias("leaf"))
    keys = scan.numbered(tree_digests(leaves, "key", "place", "leaf"), "key").select(F.lit(0).alias("all"), "position", "digest")
    root = tree_digests(keys, "all", "position", "digest").first()
    return root.digest if root else ""

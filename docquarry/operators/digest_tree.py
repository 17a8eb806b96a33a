"""A tree of digests over a table, which tells whether two builds are equal and, if not, where they differ.

Rows are dealt to leaves by a hash of their key. A leaf's digest is made from sums over the SHA-256 of its rows, so neither
the order of rows nor of columns counts, but how often a row occurs does. A node's digest is that of its children's, up to
one root. Two trees are compared from the root down; rows are read only in the leaves that differ. Where a table is
written by leaf, those leaves are the only folders that are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Children of a node, as a power of two, and levels below the root: 4096 leaves.
BITS, LEVELS = 4, 3
#: Rows of differing leaves that are named in a filter; more are joined.
NAMED = 256


def leaf_of(*keys: str, bits: int = BITS, levels: int = LEVELS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits * levels).cast("int")


def row_digest(df: DataFrame) -> Column:
    """256 bits of all columns by their names, nulls told from absent and empty ones."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def digest_tree(df: DataFrame, *keys: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Rows (level, node, n, digest), level 0 being the root; nodes without rows are left out. An empty table has none."""
    quarters = [F.conv(F.substring(F.col("d"), 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    rows = df.select(leaf_of(*keys, bits=bits, levels=levels).alias("node"), row_digest(df).alias("d"))
    sums = rows.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(q).cast("string").alias(f"s{i}") for i, q in enumerate(quarters)])
    level = sums.select(F.lit(levels).alias("level"), "node", "n", F.sha2(F.concat_ws(" ", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("digest"))
    tree = [level]
    for k in range(levels - 1, -1, -1):
        above = level.groupBy(F.shiftright("node", bits).alias("node")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"))
        level = above.select(F.lit(k).alias("level"), "node", "n", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), " "), 256).alias("digest"))
        tree.append(level)
    return reduce(DataFrame.unionByName, tree)


def differing_leaves(one: DataFrame, other: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Leaves (node) that differ between two trees, found from the root down: no child of equal nodes is looked at."""
    within = None
    for k in range(levels + 1):
        a, b = (t.where(F.col("level") == k).select("node", F.col("digest").alias(c)) for t, c in ((one, "_a"), (other, "_b")))
        if within is not None:
            a, b = (t.join(within, F.shiftright(t["node"], bits) == within["_above"], "left_semi") for t in (a, b))
        apart = a.join(b, "node", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        within = apart.select(F.col("node").alias("_above"))
    return apart


def write_by_leaf(df: DataFrame, path: str, *keys: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """``df`` in folders by the first level below the root, sorted by leaf (column _leaf), read back."""
    leaf = leaf_of(*keys, bits=bits, levels=levels)
    rows = df.withColumn("_leaf", leaf).withColumn("_branch", F.shiftright("_leaf", bits * (levels - 1)))
    rows.repartitionByRange("_branch", "_leaf").sortWithinPartitions("_branch", "_leaf").write.partitionBy("_branch").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def rows_of_leaves(df: DataFrame, leaves: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Rows of a table written by leaf that lie in ``leaves``; few leaves are named, so only their folders are read."""
    some = [r[0] for r in leaves.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return df.where(F.col("_branch").isin(sorted({x >> (bits * (levels - 1)) for x in some})) & F.col("_leaf").isin(sorted(some))).drop("_leaf", "_branch")
    return df.join(leaves.select(F.col("node").alias("_leaf")), "_leaf", "left_semi").drop("_leaf", "_branch")


def changed_rows(before: DataFrame, after: DataFrame, *keys: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """The keys of what two tables written by leaf don't share, with change: removed, added or changed (rows that repeat
    count as often as they occur)."""
    plain = lambda df: df.drop("_leaf", "_branch")
    trees = [digest_tree(plain(df), *keys, bits=bits, levels=levels) for df in (before, after)]
    leaves, _ = settled(differing_leaves(*trees, bits=bits, levels=levels), "leaves")
    sides = []
    for df, name in ((before, "_b"), (after, "_a")):
        rows = rows_of_leaves(df, leaves, bits, levels)
        own = [F.col(k).alias(f"{name}_{k}") for k in keys]
        sides.append(rows.select(*own, row_digest(rows).alias("d")).groupBy(*[f"{name}_{k}" for k in keys]).agg(F.sort_array(F.collect_list("d")).alias(name)))
    same = reduce(Column.__and__, [F.col(f"_b_{k}").eqNullSafe(F.col(f"_a_{k}")) for k in keys])
    met = sides[0].join(sides[1], same, "full").where(~F.col("_b").eqNullSafe(F.col("_a")))
    change = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added").otherwise("changed")
    return met.select(*[F.coalesce(f"_b_{k}", f"_a_{k}").alias(k) for k in keys], change.alias("change"))

"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation (a minimum per node, combined before the shuffle) and an equi-join. A node may have
very many links, and at the end the smallest node of a component has all of them: joins are therefore dealt by node and
salt, after an exchange of their own on both sides, which Spark may split further. Nothing is collected; each step's edges
are a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store

#: Parts into which the links of one node are dealt.
SALTS = 8
#: Most keys of a split join whose rows are not dealt by key, and the fewest rows that such a key has.
HOT_KEYS, HOT_ROWS = 256, 64


def salted_join(rows: DataFrame, lows: DataFrame, key: list[str], spread: str) -> DataFrame:
    """rows joined with lows, which has one row a key. Rows of one key are dealt over SALTS tasks by another column; lows
    stands in each."""
    copies = lows.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*key, "_salt"]).drop("_salt")


def split_join(rows: DataFrame, lows: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with lows, which has one row a key and in `_n` the number of rows of that key. Rows of the most
    frequent keys meet a broadcast of at most HOT_KEYS rows, all others are dealt by key. Null keys join with nothing.
    Nothing is copied, but the plan is larger than a salted join's: for joins that do not stand in a loop."""
    top = F.broadcast(lows.filter(F.col("_n") >= HOT_ROWS).orderBy(F.desc("_n"), *key).limit(HOT_KEYS).drop("_n"))
    rest = rows.join(top, key, "left_anti").join(lows.drop("_n"), key)
    return rows.join(top, key).unionByName(rest)


def _star(edges: DataFrame) -> DataFrame:
    """Connect to the smallest neighbour: u to m, and every other neighbour of u to m."""
    return salted_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), ["u"], "v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of long ids to (node, root): the smallest id reachable, for every node that has a link to another.

    Null ends and self-links are ignored; repeated links count once; no links give an empty table. The result reads a
    stored table, which `discard` of it deletes.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = store(pairs, "links"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, low, ["u"], "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = store(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        seen = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if seen == state:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._stored_at = now._stored_at
            return out
        state = seen

"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import written

#: Most parts that the links of one node are dealt into for a join.
MOST_SALTS = 64


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(edges: DataFrame, large: bool, salts: int) -> DataFrame:
    """Links every neighbour that is larger (or, small-star, not larger) to the smallest node nearby.

    The minimum of a node's neighbours is added up before the shuffle.  For the join back, a node's links
    are dealt into ``salts`` parts by their other end, so a node with very many links makes no hot task.
    """
    near = _both(edges) if large else _both(edges).where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if salts > 1:
        dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        linked = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(dealt, ["u", "salt"])
    else:
        linked = near.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Is every node linked to the root of a star alone?  And into how many parts a join should deal a node's links."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("b").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    row = each.agg(F.coalesce(F.max((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)), F.lit(False)).alias("open"), F.max(F.col("down") + F.col("up")).alias("most"), F.sum("down").alias("n")).first()
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return not row["open"], max(1, min(MOST_SALTS, (row["most"] or 0) * partitions // max(1, 2 * (row["n"] or 0))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long) that isn't the smallest of its component.

    Each step is written to the shared folder; the steps end when every component is a star about its smallest node.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        done, salts = _state(current)
        if done:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current = written(_star(_star(current, True, salts), False, salts), "links")

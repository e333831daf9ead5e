"""Grids out of tables, text and files: DataFrames of gid, h, w, g and err."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of this many neighbouring orders make one grid, so the number of grids grows with the table.
ORDERS = 16
#: The same for grids with more room in them.
FEW_ORDERS = 4
SIDE = 12


def framed(df: DataFrame) -> DataFrame:
    """gid and g with their sizes and an empty err."""
    return df.select("gid", F.size("g").alias("h"), F.size(F.get("g", F.lit(0))).alias("w"), "g", F.lit(None).cast("string").alias("err"))


def from_text(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """Grids from literals: rows of digits with spaces between them."""
    df = spark.createDataFrame(rows, "gid long, text string")
    digits = F.transform(F.split("text", " "), lambda row: F.transform(F.filter(F.split(row, ""), lambda x: x != ""), lambda x: x.cast("int")))
    return framed(df.select("gid", digits.alias("g")))


def _drawn(bits: Column) -> Column:
    """Grids from three numbers of each colour, whole Arrow batches at once; the largest colour of a cell shows."""

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            held = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), 3, SIDE // 4, 1) >> np.arange(4 * SIDE) & 1
            values = (held.reshape(len(column), 3, SIDE * SIDE) * np.array([[1], [2], [3]])).max(1).astype(np.int32).ravel()
            ends = np.arange(0, len(values) + 1, SIDE, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(ends), SIDE, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))

    return run.asNondeterministic()(bits)


def from_lineitem(spark: SparkSession, sf_dir: str, orders: int = ORDERS) -> DataFrame:
    """12 x 12 grids: a line of an order is a cell (part, quantity) of colour 1 to 3; where lines meet the larger colour shows.

    Lines are added up as bits, four rows of a grid in a number for each colour, so tasks hand over a few numbers a grid.  Grids are
    then dealt to all cores: as bits they are so small that Spark would put them in one task with all that follows.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row, column = F.col("l_partkey") % SIDE, F.col("l_quantity").cast("int") % SIDE
    bit = F.get(F.array(*[F.lit(1 << k) for k in range(4 * SIDE)]).cast("array<bigint>"), (row % 4 * SIDE + column).cast("int"))
    color, part = 1 + F.col("l_linenumber") % 3, F.floor(row / 4)
    sums = [F.coalesce(F.bit_or(F.when((color == v) & (part == k), bit)), F.lit(0).cast("long")).alias(f"b{v}{k}") for v in (1, 2, 3) for k in range(SIDE // 4)]
    bits = lines.groupBy(F.floor(F.col("l_orderkey") / orders).alias("gid")).agg(*sums).repartition(2 * spark.sparkContext.defaultParallelism, "gid")
    return framed(bits.select("gid", _drawn(F.array(*[F.col(f"b{v}{k}") for v in (1, 2, 3) for k in range(SIDE // 4)])).alias("g")))


def to_cells(grids: DataFrame) -> DataFrame:
    """One row (gid, r, c, v) for each cell, and one of -1s for each refused grid."""
    cells = F.flatten(F.transform("g", lambda row, r: F.transform(row, lambda v, c: F.struct(r.alias("r"), c.alias("c"), v.alias("v")))))
    none = F.array(F.struct(F.lit(-1).alias("r"), F.lit(-1).alias("c"), F.lit(-1).alias("v")))
    return grids.select("gid", F.explode(F.coalesce(cells, none)).alias("x")).select("gid", "x.r", "x.c", "x.v")

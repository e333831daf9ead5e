"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own (k-means on a bounded sample), so a
pair of centroids names a cell; there are about as many cells as entries / ``PER_CELL``.
For a query the pairs are visited in the order of their summed inner products, by a heap
over the two sorted lists, until the visited cells hold a share of all entries.  That
share is fitted: it is the least one that finds ``RECALL`` of the nearest neighbours
within the sample.  Where vectors have structure it is small.  Vectors without any (as
uniform ones on a sphere) need much of the table, whatever the index.  All entries of the
visited cells are ranked again by the exact inner product in double precision.

Cells in the order of their centroids make blocks of about ``BLOCK`` entries, and a query
goes to the blocks of its cells alone.  A cell of more entries than that is dealt into
blocks of its own by hash, and a block that many queries visit is dealt into groups of
``QUERIES`` of them, so neither a common vector nor a full cell makes a hot task.  Equal
vectors are one entry that keeps its ``k + 1`` smallest ids, which is all that any answer
can use; equal query vectors are searched once.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part, as queries or entries; rows without id
neither.  An id with several vectors is an entry for each.  Fewer than k candidates:
all of them.  A query whose visited cells hold fewer than k others visits more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.shared import table, written

#: Vectors that the index is fitted on, and queries among them that the share is fitted on.
SAMPLE, TRIED = 20_000, 256
#: Entries of a cell on average, and bounds of the centroids of a half.
PER_CELL, FEWEST, MOST = 48, 4, 256
RECALL = 0.96
BLOCK, QUERIES = 8192, 1024


def kmeans(points: np.ndarray, k: int, steps: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].astype(float)
    for _ in range(steps):
        which = nearest(points, centres)
        counts = np.bincount(which, minlength=len(centres))
        sums = np.stack([np.bincount(which, points[:, d], minlength=len(centres)) for d in range(points.shape[1])], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, 1)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, centroids: int) -> MultiIndex:
        """Centroids of both halves, those of the first in the order of their main direction, so that near cells are neighbours."""
        half = sample.shape[1] // 2
        first, second = kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids, seed=1)
        ordered = lambda x: x[np.argsort((x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0], kind="stable")] if x.size else x
        return cls(ordered(first), ordered(second))

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return nearest(vectors[:, :half], self.first) * len(self.second) + nearest(vectors[:, half:], self.second)

    def traversed(self, query: np.ndarray) -> Iterator[int]:
        """All cells by falling sum of both halves' inner products with the query."""
        half = self.first.shape[1]
        one, two = -(self.first @ query[:half]), -(self.second @ query[half:])
        order_one, order_two = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        one, two, order_one, order_two = one[order_one].tolist(), two[order_two].tolist(), order_one.tolist(), order_two.tolist()
        heap = [(one[0] + two[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order_one[i] * len(two) + order_two[j]
            if j + 1 < len(two):
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):  # each pair enters once: along its row, rows along the first column
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))

    def visited(self, query: np.ndarray, held: np.ndarray, enough: int) -> np.ndarray:
        """Marks of the cells visited for a query until they hold ``enough``; ``held``: entries of each cell."""
        out, total = np.zeros(self.cells, bool), 0
        for cell in self.traversed(query):
            if total >= enough:
                break
            out[cell] = True
            total += int(held[cell])
        return out

    def share(self, sample: np.ndarray, k: int, recall: float = RECALL) -> float:
        """The least share of entries to visit that finds ``recall`` of the k nearest others, by queries of the sample."""
        cells = self.cell(sample)
        held = np.bincount(cells, minlength=self.cells)
        before = []
        for i in np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int):
            scores = sample @ sample[i]
            scores[i] = -np.inf
            near = np.argpartition(-scores, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else []
            order = np.fromiter(self.traversed(sample[i]), np.int64, self.cells)
            passed = np.empty(self.cells)
            passed[order] = np.cumsum(held[order]) - held[order]
            before.append(passed[cells[near]])
        seen = np.concatenate(before) if before else np.zeros(0)
        return 1.0 if not len(seen) else min(1.0, (float(np.quantile(seen, recall, method="higher")) + 1) / len(sample))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _meet(k: int):
    def run(key: tuple, queries: pa.Table, entries: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not queries.num_rows or not entries.num_rows:
            return schema.empty_table()
        cells = entries.column("cell").to_numpy() - queries.column("from")[0].as_py()
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        vectors = _matrix(entries.column("embedding"), entries.num_rows)[order]
        smallest = pa.compute.list_element(entries.column("ids"), 0).to_numpy()[order]
        names = queries.column("query").to_numpy()
        marks = np.unpackbits(np.frombuffer(b"".join(queries.column("marks").to_pylist()), np.uint8).reshape(queries.num_rows, -1), axis=1)
        asked = _matrix(queries.column("embedding"), queries.num_rows)
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        out_query, out_score, out_row = [], [], []
        for at in range(0, len(asked), 256):
            block = asked[at : at + 256]
            scores = np.full((len(block), len(vectors)), -np.inf)
            for start, end in zip(starts, np.r_[starts[1:], len(cells)]):
                rows = np.flatnonzero(marks[at : at + 256, cells[start]])
                if len(rows):
                    scores[rows, start:end] = block[rows] @ vectors[start:end].T
            for i, row in enumerate(scores):
                if len(row) > k + 1:
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    found = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf)) if np.isfinite(least) else np.flatnonzero(row > -np.inf)
                else:
                    found = np.flatnonzero(row > -np.inf)
                exact = (vectors[found] * block[i]).sum(1)
                best = np.lexsort((smallest[found], -exact))[: k + 1]
                out_query.append(np.full(len(best), names[at + i]))
                out_score.append(exact[best])
                out_row.append(order[found[best]])
        rows = np.concatenate(out_row)
        ids = entries.column("ids").take(pa.array(rows)).combine_chunks()
        return pa.Table.from_arrays([pa.array(np.concatenate(out_query)), pa.array(np.concatenate(out_score)), ids], schema=schema)

    return run


def dealt(held: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell, in order: its first block, and in how many blocks it is (more than one: dealt by hash)."""
    first, parts = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    number = size = members = 0
    for cell, n in enumerate(held.tolist()):
        if members and size + n > block:
            number, size, members = number + 1, 0, 0
        first[cell], parts[cell] = number, max(1, -(-n // block))
        size, members = size + n, members + 1
        if parts[cell] > 1:
            number, size, members = number + int(parts[cell]), 0, 0
    return first, parts


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest found of each row that ``is_query`` marks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("embedding"), is_query.alias("asked"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dimension = sizes[0]["size"]
    rows = rows.where(F.size("embedding") == dimension)

    # Spark limits the rows of each vector before the shuffle, too.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = first.groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = written(distinct.withColumn("hash", F.xxhash64(F.col("ids")[0], F.lit(7))), "vectors")
    n_entries = distinct.count()
    sample = distinct.orderBy("hash").limit(SAMPLE).select("embedding").toArrow()
    sample = _matrix(sample.column(0), sample.num_rows)
    index = MultiIndex.fit(sample, min(MOST, max(FEWEST, round((n_entries / PER_CELL) ** 0.5))))
    enough = max(k + 1, int(np.ceil(index.share(sample, k) * n_entries)))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cell(_matrix(batch.column(0), batch.num_rows)).astype(np.int32))], names=[*batch.schema.names, "cell"])

    entries = written(distinct.mapInArrow(place, "embedding array<double>, ids array<long>, hash long, cell int"), "entries")
    counted = entries.groupBy("cell").count().toArrow()  # at most one row for each of MOST ** 2 cells
    held = np.zeros(index.cells, np.int64)
    held[counted.column("cell").to_numpy()] = counted.column("count").to_numpy()
    first, parts = dealt(held)
    blocks = np.unique(first)
    from_cell = np.searchsorted(first, blocks)  # a block's cells lie together
    to_cell = np.r_[from_cell[1:], len(held)]

    def traverse(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                marks = index.visited(_matrix(batch.column(1).slice(row, 1), 1)[0], held, enough) & (held > 0)
                block, start, bits = [], [], []
                for n in np.unique(np.searchsorted(blocks, first[marks])):
                    own = np.packbits(marks[from_cell[n] : to_cell[n]]).tobytes()
                    for part in range(int(parts[from_cell[n]]) if to_cell[n] - from_cell[n] == 1 else 1):
                        block.append(int(blocks[n]) + part)
                        start.append(int(from_cell[n]))
                        bits.append(own)
                one = batch.slice(row, 1).take(pa.array(np.zeros(len(block), np.int32)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(block, pa.int64()), pa.array(start, pa.int32()), pa.array(bits, pa.binary())], names=[*batch.schema.names, "block", "from", "marks"])

    def at_home(batches):
        for batch in batches:
            if batch.num_rows:
                cell = batch.column(2).to_numpy()
                block = first[cell] + batch.column(3).to_numpy() % parts[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block)], names=["embedding", "ids", "cell", "block"])

    asked = written(rows.where("asked").select("id", "embedding", F.xxhash64("embedding").alias("query")), "asked")
    queries = asked.groupBy("query", "embedding").agg(F.min("id").alias("id")).select("query", "embedding")
    queries = queries.repartition(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(traverse, "query long, embedding array<double>, block long, from int, marks binary")
    queries = written(queries, "queries")
    groups = written(queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups")), "groups")
    left = queries.join(groups, "block").withColumn("q", F.pmod(F.xxhash64("query", F.lit(1)), F.col("groups")).cast("int")).drop("groups")
    homes = entries.select("embedding", "ids", "cell", F.pmod(F.xxhash64("hash", F.lit(2)), F.lit(1 << 30)).cast("int").alias("n")).mapInArrow(at_home, "embedding array<double>, ids array<long>, cell int, block long")
    dealt_to = groups.select(F.col("block").alias("at"), F.expr("sequence(0, groups - 1)").alias("all"))
    right = homes.join(dealt_to, F.col("block") == F.col("at")).select("embedding", "ids", "cell", "block", F.explode("all").alias("q"))
    met = left.groupBy("block", "q").cogroup(right.groupBy("block", "q")).applyInArrow(_meet(k), "query long, score double, ids array<long>")
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("n") <= k + 1)
    answers = best.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("found"))
    pairs = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("id")))))
    answers = answers.select("query", F.slice(F.array_sort(pairs), 1, 2 * k + 2).alias("found"))
    out = asked.join(answers, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    out = out.select("query_id", F.posexplode("found").alias("n", "near"))
    return out.select("query_id", (F.col("n") + 1).alias("rank"), F.col("near.id").alias("vec_id"), (-F.col("near.far")).alias("score"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

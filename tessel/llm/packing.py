"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most ``capacity`` tokens (only longer documents
are cut).  A piece that fills a sequence has one of its own.  All others are dealt
by hash into blocks of about ``block`` pieces; a block is one bin-packing problem,
solved on ``ISLANDS`` islands (rows of a DataFrame), each with its own population of
packings.  An island's generation injects whole well-filled bins of one parent into
another, empties the other's bins that held the same pieces, and puts the displaced
pieces back by best fit.  Between epochs each island's elite moves to the next
island of the block (a shuffle of bounded rows), and the block's best packing wins.
The emptiest of a block's poorly filled bins, with at most ``AGAIN`` of its pieces, are
emptied; their pieces make fewer new blocks with those of other blocks and are packed
again, until one block is left, so blocks cost no sequences of their own.

A block that reaches ceil(tokens / capacity) bins is optimal and stops evolving.

Edge cases: null or empty texts still have the end id, so every row gets a piece;
repeated rows and null ids are pieces of their own; an empty table packs to an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.batches import BatchEncoder
from tessel.llm.bpe import read_spec
from tessel.llm.shared import table, written

BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
#: Bins filled below this share of the capacity are packed again with those of other blocks, up to this share of a block's pieces.
WELL_FILLED, AGAIN = 0.97, 0.25
_SENT = 64 << 20  # bytes of ids in one batch, about


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids binary: unsigned little-endian 32-bit) of each document's pieces."""
    spec = read_spec(docs.sparkSession, tokenizer)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = BatchEncoder.of(spec.value)
        end = np.array([end_id], "<u4").tobytes()
        together = max(1, _SENT // (4 * capacity))
        for batch in batches:
            for at, bounds, ids in encoder.parts(batch.column(1), end):
                tokens = np.diff(bounds) // 4
                cuts = -(-tokens // capacity)
                row = np.repeat(np.arange(len(cuts)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(tokens[row] - start, capacity)
                begin = np.append(bounds[row] + 4 * start, bounds[-1])
                for some in range(0, len(row), together):
                    part = slice(some, some + together)
                    edges = begin[some : some + together + 1]
                    packed = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges - edges[0]).astype(np.int32)), ids.slice(edges[0], edges[-1] - edges[0])])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at + row[part])), pa.array(piece[part], pa.int32()), pa.array(start[part]), pa.array(length[part]), packed],
                        names=["id", "piece", "start", "length", "ids"],
                    )

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("id", id_column)


# --- one island -------------------------------------------------------------------


def best_fit(sizes: list[int], order: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts the pieces of ``order`` one by one into the fullest bin with room; ``bins`` grows in place."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for k, held in enumerate(bins):
        room = capacity - sum(sizes[i] for i in held)
        by_room[room].append(k)
        rooms |= 1 << room
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= size
        by_room[room].append(k)
        rooms |= 1 << room
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square fill, which prefers full bins beside empty ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossed(sizes: list[int], taker: list[list[int]], giver: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Injects some of the giver's best-filled bins into the taker and best-fits what they displace."""
    ranked = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    share = ranked[: max(1, len(ranked) // 2)]
    chosen = [share[k] for k in np.flatnonzero(rng.random(len(share)) < 0.5)] or share[:1]
    moved = {i for b in chosen for i in b}
    kept, displaced = [], []
    for held in taker:
        if moved.isdisjoint(held):
            kept.append(held)
        else:
            displaced += [i for i in held if i not in moved]
    # Mutation: some of the worst bins are emptied too.
    kept.sort(key=lambda b: -sum(sizes[i] for i in b))
    for held in kept[len(kept) - max(1, len(kept) // 20) :]:
        displaced += held
    kept = kept[: len(kept) - max(1, len(kept) // 20)]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, displaced, [[*b] for b in [*chosen, *kept]], capacity)


def _to_bins(of: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return [b for b in bins if b]


def _from_bins(bins: list[list[int]], n: int) -> bytes:
    of = np.zeros(n, "<u4")
    for k, held in enumerate(bins):
        of[held] = k
    return of.tobytes()


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS, most: int = POPULATION) -> list[list[list[int]]]:
    """A population after some generations, best first.  An empty one starts from best-fit decreasing and shuffled orders."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    if not population:
        population = [best_fit(sizes, sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), [], capacity)]
    rank = lambda p: sorted(p, key=lambda bins: fitness(sizes, bins, capacity), reverse=True)
    population = rank(population)
    if len(population[0]) > least:
        while len(population) < most:
            noisy = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
            population.append(best_fit(sizes, np.argsort(-noisy, kind="stable").tolist(), [], capacity))
        population = rank(population)
        for _ in range(generations):
            if len(population[0]) <= least:
                break
            one, other = rng.choice(len(population), 2, replace=False)
            one, other = min(one, other), max(one, other)
            population = rank([*population, crossed(sizes, population[other], population[one], capacity, rng)])[:most]
    return population


# --- islands as rows ----------------------------------------------------------------


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<u4").tolist()
                given = [np.frombuffer(p, "<u4") for p in [*(row["population"] or []), *([row["guest"]] if row["guest"] else [])]]
                found = evolve(sizes, [_to_bins(p) for p in given], capacity, (row["block"] * 31 + row["island"]) * 31 + epoch)
                score = fitness(sizes, found[0], capacity)
                out = row | {"population": [_from_bins(p, len(sizes)) for p in found], "bins": -score[0], "fill": score[1], "guest": None}
                yield pa.RecordBatch.from_pylist([out], schema=_ISLANDS)

    return run


_ISLANDS = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("population", pa.list_(pa.binary())), ("guest", pa.binary()), ("bins", pa.int32()), ("fill", pa.float64())])
_ISLANDS_SQL = "block long, island int, sizes binary, population array<binary>, guest binary, bins int, fill double"


def _packed_blocks(placed: DataFrame, capacity: int) -> DataFrame:
    """(block, slot, bin, offset, again) of pieces that have (block, slot, length); a block's rows are bounded by its dealing.

    ``again`` marks the pieces of the bins that should be packed with those of other blocks.
    """

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("slot").to_numpy())
        sizes = rows.column("length").to_numpy()[order].astype("<u4").tobytes()
        return pa.Table.from_pylist([{"block": key[0].as_py(), "island": i, "sizes": sizes} for i in range(ISLANDS)], schema=_ISLANDS)

    islands = placed.select("block", "slot", "length").groupBy("block").applyInArrow(gather, _ISLANDS_SQL)
    islands = islands.mapInArrow(_epoch(capacity, 0), _ISLANDS_SQL)
    for epoch in range(1, EPOCHS):
        islands = written(islands, "islands")
        guests = islands.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
        islands = islands.join(guests, ["block", "island"]).withColumn("guest", F.col("elite")).drop("elite")
        islands = islands.select("block", "island", "sizes", "population", "guest", "bins", "fill").mapInArrow(_epoch(capacity, epoch), _ISLANDS_SQL)
    best = islands.groupBy("block").agg(F.max_by(F.struct("sizes", F.col("population")[0].alias("of")), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("best"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, of = np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["of"], "<u4").astype(np.int64)
                order = np.argsort(of, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.ones(len(order), bool)
                first[1:] = of[order][1:] != of[order][:-1]
                offset = np.empty(len(order), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                filled, held = np.bincount(of, sizes), np.bincount(of)
                emptiest = np.argsort(filled, kind="stable")
                again = np.zeros(len(filled), bool)
                again[emptiest] = (filled[emptiest] < WELL_FILLED * capacity) & (np.cumsum(held[emptiest]) <= max(1, int(AGAIN * len(of))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(of), row["block"])), pa.array(np.arange(len(of)), pa.int32()), pa.array(of), pa.array(offset), pa.array(again[of])], names=["block", "slot", "bin", "offset", "again"]
                )

    return best.select("block", "best.sizes", "best.of").mapInArrow(spread, "block long, slot int, bin long, offset long, again boolean")


def _dealt(rest: DataFrame, first_block: int, block: int) -> tuple[DataFrame, int]:
    """``rest`` with block and slot: dealt by hash of the row number, so that no value of any column makes a block hot."""
    n = -(-rest.count() // block)
    dealt = rest.withColumn("block", F.lit(first_block) + F.pmod(F.xxhash64("row"), F.lit(max(1, n))))
    return dealt.withColumn("slot", (F.row_number().over(Window.partitionBy("block").orderBy("row")) - 1).cast("int")), n


def pack(cut: DataFrame, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """``cut`` (rows with a ``length`` of 1 to ``capacity``) with sequence_id long and offset long."""
    columns = cut.columns
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done = rows.where(F.col("length") >= capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, first = rows.where(F.col("length") < capacity), 0
    while True:
        dealt, n = _dealt(rest, first, block)
        if not n:
            return done
        placed = dealt.join(_packed_blocks(dealt, capacity), ["block", "slot"])
        settled = placed.select(*columns, (F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        if n == 1:
            return done.unionByName(settled)
        placed = written(placed, "placed")
        settled = placed.where("not again").select(*columns, (F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        done, left = done.unionByName(settled), placed.where("again").select(*rest.columns)
        rest, first = left, first + n


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens; the digest of a piece is taken from its ids."""
    cut = pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut)

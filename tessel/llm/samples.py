"""A bounded sample of labelled texts, and the one task that fits a classifier on it."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, most: tuple[int, int]) -> DataFrame:
    """(doc_id, text, target int) of at most ``most`` rows of labels 0 and 1, in the order of a hash of the id.

    ``allowed`` says which rows may be learned from.  An id with several labels counts once, with the
    largest; ids or labels that are null don't count.  Only the chosen ids, at most sum(most), are broadcast.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("target")).where(F.col("target").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(allowed).groupBy("doc_id").agg(F.max("target").alias("target"))
    order = [F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id"]
    chosen = known.where("target = 0").orderBy(*order).limit(most[0]).union(known.where("target = 1").orderBy(*order).limit(most[1]))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def _give_back() -> None:
    """Hands memory that fitting no longer needs back to the system: the worker process goes on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of the distinct rows (doc_id, text, target) of a bounded sample, in the order of id and text.

    The sample goes to one task, which Spark runs again if its executor is lost; the driver gets the model alone.
    """
    names = ["doc_id", "text", "target"]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("target", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b.cast(schema) for b in batches], schema).group_by(names).aggregate([])
        model = fit(rows.select(names).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks())
        model, rows = pickle.dumps(model), None
        _give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("target").cast("int").alias("target")).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(schema.empty_table())

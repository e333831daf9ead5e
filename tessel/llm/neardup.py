"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

Each text's set is its distinct 5-word shingles (words lower-cased A-Z; fewer than
five words: the whole sequence).  Texts with equal sets are one class from the
start.  A class has a signature of ``CHUNKS * CHUNK`` MinHash values of 16 bits,
split into ``CHUNKS`` chunks.  One differing value is allowed in a chunk: each chunk
is indexed once for every position left out.  By pigeonhole two signatures that
differ in at most ``2 * CHUNKS - 1`` values share a chunk with at most one error, so
every pair within ``MOST_DIFFERENT``, which is that number, meets in a bucket.  (Of the
pairs of similarity 0.75, 0.000003 differ in more than 35 of 72 values.)

No bucket emits its pairs.  Buckets of the same members are one.  A bucket is walked in
numpy, comparing signatures of rows that aren't yet joined, and hands over only links
that join them.  The connected components of these forests are clusters.  All classes
of a cluster are then compared in the same way on their full sets, whatever their
signatures.

Buckets and clusters have no size limit.  A large one is dealt into slices of bounded
size, each with the group's smallest row as a hub; so a group of rows that are all
alike is joined in one linear pass.  Only where the rows of a large group are still
apart after that, its slices are compared two by two, without the pairs that are joined
already.

Edge cases: without words or text a row's set is empty; it links with nothing and is
kept.  Repeated rows are one class.  Rows without id take part; their own
component_id is the smallest id reachable, null if none, and then they are kept.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.components import components
from tessel.llm.shared import table, written
from tessel.llm.text import Chunk, chunks, distinct, mix64, windows

SHINGLE, CHUNKS, CHUNK = 5, 18, 4
VALUES = CHUNKS * CHUNK
MOST_DIFFERENT = 2 * CHUNKS - 1
#: Rows of a bucket's slice, and of a cluster's (these carry full sets), and shingles of a cluster's slice.
SLICE, CLUSTER_SLICE, SLICE_SHINGLES = 2048, 256, 1 << 20
_MULTIPLIERS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    starts, ends = chunk.words()
    hashes, doc = chunk.hashes(starts, ends, True), chunk.owner(starts)
    found, first = windows(hashes, doc, SHINGLE)
    docs, shingles = [doc[first]], [found]
    n_words = np.bincount(doc, minlength=chunk.n)
    for k in range(1, SHINGLE):
        found, first = windows(hashes, doc, k)
        whole = n_words[doc[first]] == k
        docs.append(doc[first][whole])
        shingles.append(mix64(found[whole] + np.uint64(k)))
    docs, shingles = np.concatenate(docs), np.concatenate(shingles)
    order = np.argsort(docs, kind="stable")
    return distinct(docs[order], shingles[order])


def _set_names(doc: np.ndarray, shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit name of each text's set."""
    sizes = np.bincount(doc, minlength=n)
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
    return sizes, mix64(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, other long, n_shingles long, node long: the set's name, null if empty, signature binary) of each row.

    ``other`` names the texts of rows without id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), 1 << 20):
                doc, shingles = shingle_sets(chunk)
                sizes, names = _set_names(doc, shingles, chunk.n)
                filled = np.flatnonzero(sizes)
                signature = np.zeros((chunk.n, VALUES), "<u2")
                if len(filled):
                    first = np.cumsum(sizes)[filled] - sizes[filled]
                    work = np.empty_like(shingles)
                    for k, by in enumerate(_MULTIPLIERS):
                        np.multiply(shingles, by, out=work)
                        signature[filled, k] = mix64(np.minimum.reduceat(work, first)) & np.uint64(0xFFFF)
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), batch.column(1).slice(chunk.first, chunk.n), pa.array(sizes.astype(np.int64)), pa.array(names, mask=empty), pa.array([None if e else s.tobytes() for e, s in zip(empty, signature)], pa.binary())],
                    names=["id", "other", "n_shingles", "node", "signature"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return _texts(docs, id_column, text_column).mapInArrow(run, f"id {kind}, other long, n_shingles long, node long, signature binary")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("id"), F.when(F.col(id_column).isNull(), F.xxhash64(text)).alias("other"), text.alias("text"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index keys of each class: every chunk of its signature with one position left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            values = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            keys = []
            for c in range(CHUNKS):
                for left_out in range(CHUNK):
                    key = np.full(len(values), c * CHUNK + left_out, np.uint64)
                    for k in range(CHUNK):
                        if k != left_out:
                            key = mix64(key * np.uint64(0x10001) + values[:, c, k])
                    keys.append(key)
            each = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(part.column(0).to_numpy(), each)), pa.array(np.tile(part.column(1).to_numpy().astype(np.int32), each))], names=["key", "node", "size"]
            )


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, shingles binary) of the wanted (node, rep, other): the full sets, from the texts of their representatives.

    A row without id meets only the class whose text it has.
    """
    same = F.col("id").eqNullSafe(F.col("rep")) & F.col("other").eqNullSafe(F.col("rep_other"))
    found = _texts(docs, id_column, text_column).join(wanted.hint("shuffle_hash"), same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), 1 << 20):
                nodes = batch.column(0).slice(chunk.first, chunk.n)
                doc, shingles = shingle_sets(chunk)
                sizes, names = _set_names(doc, shingles, chunk.n)
                ends = np.cumsum(sizes)
                own = (names == nodes.to_numpy()) & (sizes > 0)  # another text under the same id isn't this class
                sets = [shingles[e - n : e].tobytes() for e, n, x in zip(ends, sizes, own) if x]
                yield pa.RecordBatch.from_arrays([nodes.filter(pa.array(own)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first columns, joined so that no group is cut."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch])
        held = pa.concat_tables([rest, held]) if rest is not None else held
        keys = [held.column(k).to_numpy() for k in range(n_keys)]
        last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield held.slice(0, cut)
        rest = held.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _groups(held: pa.Table) -> Iterator[tuple[int, int]]:
    keys = [held.column(k).to_numpy() for k in range(3)]
    starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    yield from zip(starts.tolist(), [*starts[1:].tolist(), held.num_rows])


def _sizes_alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sets whose sizes differ too much can't reach the similarity."""
    return 100 * np.minimum(one, other) >= 75 * np.maximum(one, other)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    one, other = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], names=["a", "b"])


def _joined(start: int, end: int, across: bool, own: np.ndarray, root: np.ndarray, node: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the rows of one group; rows of equal label (by root, then by links found) aren't compared."""
    label = np.unique(root[start:end], return_inverse=True)[1]
    apart = int(label.max())
    for at in range(end - start):
        if not apart:
            return
        rest = label[at + 1 :] != label[at]
        if across:
            rest &= own[start + at + 1 : end] != own[start + at]
        rest = np.flatnonzero(rest) + at + 1
        if not len(rest):
            continue
        rest = rest[alike(start + at, start + rest)]
        if len(rest):
            names, first = np.unique(label[rest], return_index=True)
            yield np.full(len(names), node[start + at]), node[start + rest[first]]
            label[np.isin(label, names)] = label[at]
            apart -= len(names)


def _walk(batches: Iterator[pa.RecordBatch], reader: Callable[[pa.ChunkedArray, np.ndarray], Callable[[int, np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for held in _grouped(batches, 3):
        p, q, own, root, node, size = (held.column(k).to_numpy() for k in range(1, 7))
        alike, out = reader(held.column(7), size), []
        for start, end in _groups(held):
            out += _joined(start, end, p[start] != q[start], own, root, node, alike)
        yield _links(out)


def _near_signatures(column: pa.ChunkedArray, size: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    signature = _signatures(column)
    return lambda at, rest: ((signature[rest] != signature[at]).sum(1) <= MOST_DIFFERENT) & _sizes_alike(size[rest], size[at])


def _similar_sets(column: pa.ChunkedArray, size: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]

    def similar(at: int, rest: np.ndarray) -> np.ndarray:
        out = _sizes_alike(size[rest], size[at])
        own = rest[out]
        if len(own):
            every = np.concatenate([sets[k] for k in own])
            place = np.minimum(np.searchsorted(sets[at], every), len(sets[at]) - 1)
            lengths = size[own].astype(np.int64)
            common = np.add.reduceat((sets[at][place] == every).astype(np.int64), np.cumsum(lengths) - lengths)
            out[out] = 100 * common >= 75 * (lengths + size[at] - common)
        return out

    return similar


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of near signatures that join the rows of each bucket's slice, or of two slices."""
    yield from _walk(batches, _near_signatures)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, confirmed on full sets, that join the classes of a cluster's slice, or of two slices."""
    yield from _walk(batches, _similar_sets)


def _linked(rows: DataFrame, key: str, walk: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], payload: str) -> DataFrame:
    """(node, root) of all nodes that links join: of a written table (key, slices int, node, size, payload) of groups."""
    columns = [key, "p", "q", "own", "root", "node", "size", payload]
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).withColumn("root", F.col("node"))
    large = rows.where("slices > 1")
    hubs = large.groupBy(key).agg(F.min(F.struct("node", "size", payload, "slices")).alias("hub")).select(key, "hub.*", F.lit(-1).alias("own"), F.col("hub.node").alias("root"))
    hubs = hubs.withColumn("p", F.explode(F.expr("sequence(0, slices - 1)"))).withColumn("q", F.col("p"))
    once = rows.withColumn("p", F.col("own")).withColumn("q", F.col("own")).select(*columns).union(hubs.select(*columns))
    dealt = lambda each: each.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")
    roots = components(dealt(once).mapInArrow(walk, "a long, b long"))
    if large.isEmpty():
        return roots
    known = large.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = known.groupBy(key).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select(key)
    known = written(known.join(apart, key, "left_semi"), "apart")
    if known.isEmpty():
        return roots
    twice = known.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))).where("own <> other")
    twice = twice.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).select(*columns)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(dealt(twice).mapInArrow(walk, "a long, b long")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean) of each row of ``docs``."""
    prints = written(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = prints.where("node is not null").groupBy("node", F.col("n_shingles").cast("int").alias("size"), "signature").agg(F.min("id").alias("rep"), F.min("other").alias("rep_other"))
    classes = written(classes.withColumn("rep_other", F.when(F.col("rep").isNull(), F.col("rep_other"))), "classes")
    keys = classes.select("node", "size", "signature").mapInArrow(_keys, "key long, node long, size int")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other")).where("n > 1")
    shared = shared.groupBy("n", "one", "other").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    met = written(keys.join(shared, "key").join(classes.select("node", "signature"), "node").select("key", "slices", "node", "size", "signature"), "buckets")
    roots = _linked(met, "key", _forest, "signature")

    members = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    members = written(members.join(classes.select("node", "rep", "rep_other", "size"), "node"), "members")
    sets = _sets(docs, members.select("node", "rep", "rep_other"), id_column, text_column)
    many = F.greatest(F.count(F.lit(1)) / CLUSTER_SLICE, F.sum("size") / SLICE_SHINGLES)
    full = members.select("node", "root", "size").join(members.groupBy("root").agg(F.ceil(many).cast("int").alias("slices")), "root").join(sets, "node")
    roots = _linked(written(full.select(F.col("root").alias("cluster"), "slices", "node", "size", "shingles"), "clusters"), "cluster", _joining, "shingles")

    grouped = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = grouped.join(smallest, "root").select("node", "component_id")
    out = prints.select("id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS l FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id, d.doc_id = m.y AS kept
FROM documents d JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id LEFT JOIN n USING (doc_id)
"""

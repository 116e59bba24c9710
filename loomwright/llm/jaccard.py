"""Similarity join of documents on word n-grams: every link of Jaccard similarity at or above a threshold.

1. One pass over the texts gives each document's set size and a 128-bit fingerprint of its set, and counts all
   n-grams in a sketch of fixed size. Documents with equal sets form one class, which its smallest id stands for.
2. A second pass orders each set rarest first (sketch count, then hash: one total order for all documents) and
   emits its prefix. Copies within a task emit once, so a group of copies never floods a key.
3. Documents that share a prefix n-gram are candidates if the length filter and the positional filter let them
   pass. Within a key, documents are first compared with a few pivots, then those that are still in different
   components with more pivots, and what that leaves in different components exhaustively. Links inside a
   component are never expanded, and no partner is capped.
4. The suffix filter parts both sets alike and bounds what they can share by the sizes of the parts, from a small
   signature of each set; it goes before the texts are fetched. What passes is verified once a pair on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import WordHashes, columns_of, connected_components, grams, hashed_words, join_counted, materialize, mix, pieces, release, texts, worker_memory

WORDS, PERCENT = 5, 75
#: The sketch has 2 ** SKETCH_BITS counters, which are kept in blocks.
SKETCH_BITS, BLOCK = 20, 1 << 14
#: Rounds of comparisons within a key: with pivots picked by these hash seeds, and at last of all with all.
PIVOTS = (range(4), range(4, 20), None)
#: The suffix filter parts a set into 2 ** PART_BITS by the first bits of its hashes.
PART_BITS = 7


def shingle_set(words: list[bytes], hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of the whole sequence, if it has fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    ids = hashed_words(words, hashes)
    if len(ids) < n:
        return grams(ids, len(ids)) ^ np.uint64(len(ids))
    out = grams(ids, n)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def part_sizes(s: np.ndarray) -> bytes:
    """A byte for the size of each part; 255 stands for all larger ones, which only weakens the filter."""
    return np.minimum(np.bincount(s >> np.uint64(64 - PART_BITS), minlength=1 << PART_BITS), 255).astype(np.uint8).tobytes()


def _sets(batch: pa.RecordBatch, hashes: WordHashes, n: int, column: str = "text") -> Iterator[np.ndarray]:
    for text in texts(batch, column):
        yield shingle_set(text.lower().split(), hashes, n)  # bytes: only A-Z change, only ASCII white space splits


def _statistics(docs: DataFrame, n: int) -> DataFrame:
    """Rows of kind 0: id, size, fingerprint and parts of a set. Rows of kind 1: a block of the sketch of one task."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("parts", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        hashes, sketch = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(_sets(part, hashes, n))
                every = np.concatenate(sets)
                sketch += np.bincount(every >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch)).astype(np.uint32)
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int32)), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array([part_sizes(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.binary())], schema=schema
                )
        blocks = [sketch[i : i + BLOCK].tobytes() for i in range(0, len(sketch), BLOCK)]
        k = len(blocks)
        none = pa.array([0] * k, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(range(k), pa.int64()), none, none, none, pa.nulls(k, pa.binary()), pa.array(blocks)], schema=schema)

    return materialize(docs.mapInArrow(count, "kind int, id long, n long, h1 long, h2 long, parts binary, counts binary"), "statistics")


def _sketch(statistics: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, 4 bytes a counter; summed in two steps, so that no task gets all of them."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist())
        return pa.table({"id": table.column("id")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()])})

    salted = statistics.where("kind = 1").select("id", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("salt"))
    once = salted.groupBy("id", "salt").applyInArrow(add, "id long, counts binary")
    rows = once.groupBy("id").applyInArrow(add, "id long, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["id"] * BLOCK : (r["id"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return out


def _prefixes(docs: DataFrame, frequency, n: int, percent: int) -> DataFrame:
    """g, doc_id, n, pos: the prefix of every set in the common order, rarest first."""
    schema = pa.schema([("g", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for part in pieces(batch, "text"):
                g, ids, sizes, places = [], [], [], []
                for doc, s in zip(part.column("doc_id").to_pylist(), _sets(part, hashes, n), strict=True):
                    key = (len(s), int(s.sum(dtype=np.uint64)))
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    keep = len(s) - (percent * len(s) + 99) // 100 + 1
                    g.append(s[np.lexsort((s, frequency.value[s >> np.uint64(64 - SKETCH_BITS)]))[:keep]])
                    ids.append(np.full(keep, doc))
                    sizes.append(np.full(keep, len(s), np.int32))
                    places.append(np.arange(keep, dtype=np.int32))
                if g:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([np.concatenate(g).view(np.int64)], ids, sizes, places)], schema=schema)

    return docs.mapInArrow(emit, "g long, doc_id long, n int, pos int")


def _may_link(percent: int) -> F.Column:
    """Length filter, and positional filter at a common prefix n-gram, of two rows x and y.

    A pair that links passes at its first common n-gram, as all that the two share comes from there on.
    """
    n, m, i, j = (F.col(c).cast("long") for c in ("x.n", "y.n", "x.pos", "y.pos"))
    least = F.expr(f"cast(ceil({percent} * (x.n + y.n) / {100 + percent}) as bigint)")
    reach = F.least(n - i, m - j)
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (reach >= least)


def suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs(a, b)`` that can share enough by the sizes of their parts, from ``sets(id, n, parts)``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int16) for c in ("pa", "pb"))
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            least = -(-percent * both // (100 + percent))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= both - 2 * least))

    first, second = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("parts").alias(f"p{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(check, "a long, b long").distinct()


def verify(pairs: DataFrame, texts_: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole texts reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        hashes, last = WordHashes(), (None, None)
        for batch in batches:
            for part in pieces(batch, "tb"):
                keep = []
                for ta, y in zip(texts(part, "ta"), _sets(part, hashes, n, "tb"), strict=True):
                    if last[0] != ta:  # a doc_id may have several texts
                        last = (ta, shingle_set(ta.lower().split(), hashes, n))
                    x = last[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (texts_.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "ta", "b", "tb").mapInArrow(check, "a long, b long").distinct()


def jaccard_links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles and rep of every document; verified links (a, b) between representatives.

    ``docs`` needs doc_id and text. Words are split at ASCII white space after lower-casing A-Z. A document with
    fewer than n words has its whole sequence as its one n-gram; one without words, or with a null text, has none
    and links with nothing. Rows without a doc_id take no part. Rows that repeat a doc_id count as one document
    with several texts: a link of any of them is a link of it. An empty table gives empty results.
    """
    spark = docs.sparkSession
    docs = columns_of(docs, "doc_id", "text").where("doc_id is not null")
    statistics = _statistics(docs, n)
    frequency = spark.sparkContext.broadcast(_sketch(statistics))
    sets = statistics.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "h1", "h2")
    classes = sets.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    # A third of all documents may be one class.
    grouped = join_counted(sets.where("n_shingles > 0"), classes, ["n_shingles", "h1", "h2"], sets.count())
    members = materialize(grouped.select("doc_id", "n_shingles", "rep").unionByName(empty), "members")

    key = Window.partitionBy("g")
    shared = (
        _prefixes(docs, frequency, n, percent)
        .withColumn("lo", F.min("doc_id").over(key))
        .withColumn("hi", F.max("doc_id").over(key))
        .where("lo < hi")
        .select("g", "doc_id", "n", "pos")
    )
    shared = materialize(shared, "shared")
    rows = shared.join(members.select("doc_id", "rep").distinct(), "doc_id").groupBy("g", F.col("rep").alias("doc_id")).agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    rows = materialize(_several(rows.withColumn("c", F.col("doc_id"))), "rows")
    release(shared)
    x, y = rows.alias("x"), rows.alias("y")
    rows = materialize(x.join(y, F.expr("x.g = y.g and x.doc_id <> y.doc_id") & _may_link(percent), "left_semi"), "rows")
    own = materialize(docs.join(rows.select("doc_id").distinct(), "doc_id"), "texts")

    tested, links = None, None
    for pivots in PIVOTS:
        x, y = rows.alias("x"), rows.alias("y")
        if pivots:
            order = F.array([F.min(F.struct(F.xxhash64("doc_id", F.lit(i)), *rows.columns)) for i in pivots])
            x = rows.groupBy("g").agg(order.alias("p")).select(F.explode("p").alias("p")).select("p.*").distinct().alias("x")
            pairs = y.join(x, F.expr("x.g = y.g and x.c <> y.c") & _may_link(percent))
        else:
            pairs = x.join(y, F.expr("x.g = y.g and x.doc_id < y.doc_id and x.c <> y.c") & _may_link(percent))
        pairs = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        hopeful = materialize(suffix_filter(pairs, statistics.where("kind = 0"), percent), "hopeful")
        found = materialize(verify(hopeful, own, n, percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if pivots:
            parts = connected_components(links)
            rows = rows.drop("c").join(parts.select(F.col("id").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
            rows = materialize(_several(rows.withColumn("c", F.coalesce("c", "doc_id"))), "rows")
    return members, links


def _several(rows: DataFrame) -> DataFrame:
    """Only rows of keys whose documents are still in different components."""
    keys = rows.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    return rows.join(keys, "g", "left_semi").select("g", "doc_id", "n", "pos", "c")


def near_duplicate_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach); see ``jaccard_links``."""
    members, links = jaccard_links(docs, n, percent)
    parts = connected_components(links)
    return (
        members.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        .unionByName(columns_of(docs, "doc_id").where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), "doc_id", ).toDF("doc_id", "n_shingles", "component_id"))
    )

"""What the operators of this subpackage share: shared storage, word hashing, connected components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.storage import materialize, release

#: Most bytes of text that an Arrow function works on at once, whatever the size of the batches that arrive.
CHUNK_BYTES = 2 << 20
#: A key is hot with more rows than HOT_ROWS and more than one of HOT_KEYS parts of all rows.
HOT_KEYS, HOT_ROWS = 2_000, 500


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of an input never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the table's, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """Tells apart texts of rows with one id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit(""))))


def worker_memory(name: str | None = None, make: Callable[[], Any] = lambda: None) -> Any:
    """What ``make`` gives, kept under ``name`` by a worker process from task to task.

    Worker processes outlive stages, so every Arrow function calls this when it starts: what is kept under other
    names goes, and memory that earlier tasks have freed goes back to the system.
    """
    module = sys.modules.setdefault("_loomwright_memory", types.ModuleType("_loomwright_memory"))
    kept = module.__dict__.setdefault("kept", {})
    for other in [k for k in kept if k != name]:
        del kept[other]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)
    if name is None:
        return make()
    if name not in kept:
        kept[name] = make()
    return kept[name]


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered up to ``most`` words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of a string column each; one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def hashed_words(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n ids, by its first."""
    size = max(0, len(ids) - n + 1)
    out = np.zeros(size, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    for j in range(n):
        out *= base
        out += ids[j : j + size]
    return mix(out)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int, size: str = "size") -> DataFrame:
    """Inner join of ``left`` with ``right``, whose keys are unique and which counts the rows of ``left`` in ``size``.

    Keys with over 1 / HOT_KEYS of the ``total`` rows of ``left`` are fewer than HOT_KEYS, so these are broadcast and
    their rows stay where they are; no task gets more than that share of the rows for one of the other keys.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.where(F.col(size) > limit).drop(size)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    here = marked.where("_hot").drop("_hot")
    there = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(size) <= limit).drop(size), on)
    return here.unionByName(there)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges(a, b)``: the smallest id that links reach.

    Alternating large-star and small-star steps. Each is a map-side combined minimum and a join back, which keeps the
    rows of hubs where they are (see ``join_counted``), so a hub with millions of neighbours never meets in one task.
    Minima and steps are written to the shared folder one by one: as one plan, a round reads its edges some 96 times
    over, and such plans, with a thread for each of their exchanges, fill the driver.
    """
    same = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    n = same.count()
    for _ in range(rounds if n else 0):
        both = same.union(same.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, near = _with_lows(both, 2 * n)
        large = materialize(large.where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).where("u <> v").distinct(), "large")
        small, lows = _with_lows(large, 2 * n)
        small = (
            small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "edges")
        m = after.count()
        changed = m != n or not after.join(same, ["u", "v"], "left_anti").isEmpty()
        release(same, near, large, lows)
        same, n = after, m
        if not changed:
            break
    else:
        if n:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return same.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        same.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _with_lows(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``edges(u, v)`` with low, the smallest v of their u; and the written table of u, low, size."""
    lows = materialize(edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("size")), "lows")
    largest = lows.agg(F.max("size")).first()[0] or 0
    if largest > max(HOT_ROWS, total // HOT_KEYS):
        return join_counted(edges, lows, ["u"], total), lows
    return edges.join(lows.drop("size"), "u"), lows

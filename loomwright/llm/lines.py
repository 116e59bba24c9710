"""Removal of lines that an earlier line equals but for at most one edit.

A deletion neighbourhood holds a line and all that it becomes by one deletion. Two lines are one substitution
apart if deleting the same place makes them equal, and one insertion apart if deleting a place of the longer one
gives the shorter one, so joining equal variants (and places) finds every pair. Variants are hashes made from
prefix sums, not strings. Only lines that may have a partner make variants: one edit leaves the first or the last
half of a line as it is, so lines are first joined on hashes of their halves. Found pairs are verified by their
edit distance. Equal lines are one line, whose first occurrence stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import fresh, join_counted, materialize, mix, pieces, text_key, texts, worker_memory

#: Two lines with fewer characters are no near copies: an edit is much of them.
LEAST_CHARACTERS = 16
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)

_BASE = np.uint64(0x9FB21C651E98DF25)
_UNBASE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def deletion_neighbourhood(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, line index): each line's own hash at place -1, and for each place that of the line without it."""
    sizes = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(len(points)) - starts[owner]
    powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    terms = mix(points + np.uint64(0x51ED27)) * powers[place]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    whole = sums[starts + sizes] - sums[starts]
    before = sums[:-1] - sums[starts][owner]
    after = whole[owner] - before - terms
    keys = np.concatenate((mix(whole), mix(before + after * _UNBASE)))
    return keys.view(np.int64), np.concatenate((np.full(len(lines), -1), place)), np.concatenate((np.arange(len(lines)), owner))


def _kept_lines(keyed: DataFrame, at: tuple[str, str], least: int, equal_from: int) -> DataFrame:
    """d, k, n of the lines of ``equal_from`` characters or more that stay.

    All that follows the search for candidates is one plan with the caller's join, and takes every column of
    ``keyed`` as that does, so that texts are shuffled once and both joins read them. ``at`` names its two keys.
    """
    d_, k_ = at
    (asked_,) = fresh(keyed, "_line_asked")
    lines = keyed.where(F.col(d_) > NO_ID).select(F.col(d_).alias("d"), F.col(k_).alias("k"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    size = F.length("line")
    long_ = lines.where(size >= equal_from)
    half = lambda n: (n / 2).cast("int")
    halves = [F.xxhash64(F.lit(kind), n, F.substring(F.col("line"), F.lit(1), half(n)) if kind == "first" else F.substring(F.col("line"), size - (n - half(n)) + 1, n - half(n))) for n in (size, size - 1) for kind in ("first", "last")]
    distinct = (
        long_.select("d", "k", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(9), "line").alias("h2"), *[F.when(size >= least - 1, h).alias(f"half{i}") for i, h in enumerate(halves)])
        .groupBy("h1", "h2", *[f"half{i}" for i in range(4)])
        .agg(F.min(F.struct("d", "k", "n")).alias("o"))
    )
    distinct = materialize(distinct.select("o.*", F.array(*[f"half{i}" for i in range(4)]).alias("halves")), "lines")
    halved = distinct.where(F.col("halves")[0].isNotNull()).select("d", "k", "n", F.explode("halves").alias("half"))
    several = halved.groupBy("half").agg(F.count("*").alias("size")).where("size > 1")
    shared = join_counted(halved, several, ["half"], 4 * distinct.count())  # a half that templated lines share is hot
    some = materialize(shared.select("d", "k", "n").distinct(), "candidates")

    asked = some.groupBy(F.col("d").alias(d_), F.col("k").alias(k_)).agg(F.collect_list("n").alias(asked_))
    schema = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("n", pa.int32()), ("line", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for d, k, text, numbers in zip(part.column(d_).to_pylist(), part.column(k_).to_pylist(), texts(part, "text"), part.column(asked_).to_pylist(), strict=True):
                    own = text.split(b"\n")
                    rows += [(d, k, n, own[n].decode()) for n in set(numbers)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    held = keyed.join(asked, [d_, k_])
    own = held.mapInArrow(cut, "d long, k long, n int, line string")

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cuts by itself: a task with one Arrow function upon another holds two workers, and workers outlive stages.
        for batch in cut(batches):
            for part in pieces(batch, "line", 1 << 19):
                key, place, line = deletion_neighbourhood(part.column("line").to_pylist())
                d, k, n = (part.column(c).to_numpy() for c in "dkn")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, place.astype(np.int32), d[line], k[line], n[line])], names=["key", "i", "d", "k", "n"])

    o = F.struct("d", "k", "n")
    variants = held.mapInArrow(vary, "key long, i int, d long, k long, n int").repartition("key")
    key, place = Window.partitionBy("key"), Window.partitionBy("key", "i")
    met = (
        variants.withColumn("shorter", F.min(F.when(F.col("i") < 0, o)).over(key))
        .withColumn("longer", F.min(F.when(F.col("i") >= 0, o)).over(key))
        .withColumn("same", F.min(o).over(place))
    )
    earlier = F.array(F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("shorter")), F.when(F.col("i") >= 0, F.col("same")))
    pairs = met.select("d", "k", "n", F.explode(F.filter(earlier, lambda w: w.isNotNull() & (w < o))).alias("w")).distinct()
    first, second = own, own.toDF("wd", "wk", "wn", "wline")
    near = (
        pairs.select("d", "k", "n", F.col("w.d").alias("wd"), F.col("w.k").alias("wk"), F.col("w.n").alias("wn"))
        .join(first, ["d", "k", "n"])
        .join(second, ["wd", "wk", "wn"])
        .where((F.greatest(F.length("line"), F.length("wline")) >= least) & F.levenshtein("line", "wline", 1).between(0, 1))
        .select("d", "k", "n")
        .distinct()
    )
    return distinct.select("d", "k", "n").join(near, ["d", "k", "n"], "left_anti")


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_CHARACTERS, equal_from: int = LEAST_CHARACTERS) -> DataFrame:
    """``docs`` with text and n_chars (where there is one) after the removal; documents left without text go.

    Lines end at line feeds; they are compared as they are. A line of ``equal_from`` characters or more goes
    if an earlier one, by doc_id and then by place, is the same or, where the longer of the two has ``least``
    characters, one inserted, deleted or substituted character away. What is earlier is judged on the input. Shorter
    lines, documents without a doc_id and texts that are null or
    empty stay as they are, but a document that loses lines and has only blanks left goes. Rows that repeat a
    doc_id are told apart by their texts; equal ones share their fate. Other columns pass through, whatever their
    names. Lines of any length are compared as a whole; an empty table gives an empty one.
    """
    names = docs.columns
    place = names.index("text")
    d_, k_, known_, stay_ = fresh(docs, "_line_d", "_line_k", "_line_known", "_line_stay")
    keyed = docs.select("*", F.coalesce(F.col("`doc_id`"), F.lit(NO_ID)).alias(d_), text_key(F.col("`text`")).alias(k_))
    kept = _kept_lines(keyed, (d_, k_), least, equal_from)
    stay = kept.groupBy(F.col("d").alias(d_), F.col("k").alias(k_)).agg(F.collect_set("n").alias(stay_))
    joined = keyed.join(stay, [d_, k_], "left").select(*[F.col(f"`{c}`") for c in names], (F.col(d_) > NO_ID).alias(known_), stay_)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in batches:
            for part in pieces(batch, "text"):
                new, rows = [], []
                known, stays = (part.column(c).to_pylist() for c in (known_, stay_))
                for row, (text, k, own_stay) in enumerate(zip(part.column(place).to_pylist(), known, stays, strict=True)):
                    own, here = (text or "").split("\n"), set(own_stay or ())
                    left = [x for n, x in enumerate(own) if not k or n in here or len(x) < equal_from]
                    if len(left) < len(own):
                        text = "\n".join(left)
                        if not text.strip(" "):
                            continue
                    new.append(text)
                    rows.append(row)
                out = part.take(pa.array(rows, pa.int64())).select(range(len(names)))
                out = out.set_column(place, "text", pa.array(new, part.column(place).type))
                if "n_chars" in names:
                    i = names.index("n_chars")
                    counted = pa.array([None if x is None else len(x) for x in new], pa.int64()).cast(out.column(i).type)
                    out = out.set_column(i, "n_chars", counted)
                yield out

    return joined.mapInArrow(rebuild, docs.schema)

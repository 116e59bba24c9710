"""Removal of passages that an earlier document holds too, by suffix automata of reference shards.

A window is ``window`` consecutive words of one document. Every window contains an anchor, the least of the
hashes of its runs of ``anchor`` words, and equal windows have equal anchors. So all copies of a window meet under
one key, and documents need not be streamed past every reference:

1. One pass finds for each anchor the region of the windows that it is the anchor of, with a hash of its content.
2. Regions that are equal as a whole are pre-aggregated to the smallest doc_id. Anchors of one document only are
   done with; so are anchors with a single content, whose windows all start in that smallest document.
3. The rest are reference regions. They are dealt by anchor into shards; a shard's suffix automaton (states carry
   the smallest doc_id of their occurrences) is sent to the task that streams the shard's regions past it for
   their matching statistics. An anchor with more regions than ``SHARD_REGIONS`` is split: each automaton of its
   parts meets each part of its regions, as a task of its own.
4. Words under windows that match an earlier document to full length are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import WordHashes, columns_of, grams, hashed_words, join_counted, materialize, pieces, release, text_key, texts, worker_memory

WINDOW, ANCHOR = 50, 10
#: Regions of one anchor that one automaton holds, and regions of all anchors that one shard holds on average.
SHARD_REGIONS, GROUP_REGIONS = 512, 512

_BASE = np.uint64(0x9FB21C651E98DF25)
_UNBASE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def anchor_regions(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(doc index, anchor hash, content hash, first window, number of windows) of all documents' regions.

    ``ids`` holds the word hashes of all documents in turn, document i from ``starts[i]`` to ``ends[i]``.
    """
    n = len(ids)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    runs = grams(ids, anchor)
    bits = np.uint64(max(1, int(n).bit_length()))
    place = np.arange(len(runs), dtype=np.uint64)
    best = (runs >> bits << bits) | place
    span = window - anchor + 1  # runs in a window
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    chosen = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # by window
    doc = np.repeat(np.arange(len(starts)), np.maximum(0, ends - starts - window + 1))
    first_of = np.repeat(starts, np.maximum(0, ends - starts - window + 1))
    counts = np.maximum(0, ends - starts - window + 1)
    at = first_of + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(at):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    pick = chosen[at]
    new = np.concatenate(([True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])))
    head = np.nonzero(new)[0]
    size = np.diff(np.concatenate((head, [len(at)])))
    lo = at[head]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * _powers(_BASE, n), dtype=np.uint64)))
    content = (sums[lo + size + window - 1] - sums[lo]) * _powers(_UNBASE, n)[lo]
    return doc[head], runs[pick[head]], content, lo - starts[doc[head]], size


def _regions(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("r", pa.int64()), ("n", pa.int32()), ("d", pa.int64()), ("k", pa.int64()), ("at", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                raw = texts(part, "text")
                split = [t.split() for t in raw]
                ends = np.cumsum([len(w) for w in split])
                ids = hashed_words([w for words in split for w in words], hashes)
                doc, h, r, lo, size = anchor_regions(ids, ends - [len(w) for w in split], ends, window, anchor)
                d = part.column("d").to_numpy(zero_copy_only=False)
                k = part.column("k").to_numpy(zero_copy_only=False)
                columns = (h.view(np.int64), r.view(np.int64), size.astype(np.int32), d[doc], k[doc], lo.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.mapInArrow(find, "h long, r long, n int, d long, k long, at int")


class SuffixAutomaton:
    """Of many word sequences. ``least[v]`` is the smallest document of the occurrences of state v, after ``finish``."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [1 << 63]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.least.append(1 << 63)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list, doc: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
            else:
                last = self._state({}, 0, self.len[p] + 1)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
            self.least[last] = min(self.least[last], doc)

    def finish(self) -> None:
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.link[v]
            self.least[up] = min(self.least[up], self.least[v])

    def earliest(self, words: list, window: int) -> list[int]:
        """For each window of ``words``, the smallest document that holds it; 2**63 where none does."""
        v = length = 0
        out = []
        for at, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if (to := self.next[v].get(word)) is not None:
                v, length = to, length + 1
            while self.len[v] and self.len[self.link[v]] >= window:
                v = self.link[v]
                length = self.len[v]
            if at >= window - 1:
                out.append(self.least[v] if length >= window else 1 << 63)
        return out


def earlier_windows(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """d, k, found: per document its regions with windows that an earlier document holds, as (at, flags by window).

    ``keyed`` has d and k, which together stand for a row, and text.
    """
    all_ = materialize(_regions(keyed.where(f"d > {-(1 << 63)}").select("d", "k", "text"), window, anchor), "regions")
    several = all_.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("size"))
    several = materialize(several.where("lo < hi").select("h", "size"), "several")
    here = materialize(join_counted(all_, several, ["h"], all_.count()), "shared")
    distinct = here.groupBy("h", "r", "n").agg(F.min(F.struct("d", "k", "at")).alias("first"), F.count("*").alias("copies"))
    distinct = materialize(distinct.select("h", "r", "n", "copies", "first.*"), "distinct")
    release(all_)
    release(several)
    sizes = distinct.groupBy("h").agg(F.count("*").alias("size"))
    rest = materialize(distinct.join(sizes.where("size > 1"), "h").withColumn("parts", F.ceil(F.col("size") / SHARD_REGIONS).cast("int")), "rest")
    shards = max(1, rest.count() // GROUP_REGIONS)

    asked = rest.groupBy("d", "k").agg(F.collect_list(F.struct("h", "r", "n", "at", "parts")).alias("asked"))
    schema = pa.schema([("h", pa.int64()), ("r", pa.int64()), ("n", pa.int32()), ("parts", pa.int32()), ("d", pa.int64()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for d, text, asked_ in zip(part.column("d").to_pylist(), texts(part, "text"), part.column("asked").to_pylist(), strict=True):
                    words = text.split()
                    rows += [(x["h"], x["r"], x["n"], x["parts"], d, b" ".join(words[x["at"] : x["at"] + x["n"] + window - 1])) for x in asked_]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    regions = keyed.join(asked, ["d", "k"]).mapInArrow(cut, "h long, r long, n int, parts int, d long, words binary")
    own = F.pmod(F.xxhash64("r", "n"), F.col("parts")).cast("int")
    single = F.array(F.struct(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), F.lit(True).alias("ref"), F.lit(True).alias("ask")))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, ref, ask: F.struct(F.xxhash64(F.lit("cell"), F.col("h"), i, j).alias("shard"), ref.alias("ref"), ask.alias("ask"))
    spread = F.concat(
        F.transform(other, lambda j: cell(F.col("own"), j, F.lit(True), j == F.col("own"))),
        F.transform(F.filter(other, lambda i: i != F.col("own")), lambda i: cell(i, F.col("own"), F.lit(False), F.lit(True))),
    )
    dealt = regions.withColumn("own", own).withColumn("to", F.explode(F.when(F.col("parts") == 1, single).otherwise(spread)))

    def stream(table: pa.Table) -> pa.Table:
        columns = table.to_pydict()
        split = [w.split(b" ") for w in columns["words"]]
        automaton = SuffixAutomaton()
        for words, d, ref in zip(split, columns["d"], columns["ref"], strict=True):
            if ref:
                automaton.add(words, d)
        automaton.finish()
        keep = [i for i, ask in enumerate(columns["ask"]) if ask]
        top = (1 << 63) - 1
        least = [[min(x, top) for x in automaton.earliest(split[i], window)] for i in keep]
        return pa.table({**{c: table.column(c).take(keep) for c in ("h", "r", "n")}, "least": pa.array(least, pa.list_(pa.int64()))})

    matched = dealt.select("h", "r", "n", "d", "words", "to.*").groupBy("shard").applyInArrow(stream, "h long, r long, n int, least array<long>")
    lone = distinct.join(sizes.where("size = 1"), "h").select("h", "r", "n", F.array_repeat("d", F.col("n")).alias("least"))
    # Only what an earlier document holds is asked for: the smallest document's own copy never is.
    least = materialize(matched.unionByName(lone), "least").join(distinct.select("h", "r", "n", "copies"), ["h", "r", "n"])
    flags = (
        join_counted(here.select("h", "r", "n", "d", "k", "at"), least, ["h", "r", "n"], here.count(), "copies")
        .where(F.array_min("least") < F.col("d"))
        .select("d", "k", F.struct("at", F.transform("least", lambda x: x < F.col("d")).alias("flags")).alias("x"))
    )
    return flags.groupBy("d", "k").agg(F.collect_list("x").alias("found"))


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the words that stay, joined by one space).

    A null or empty text has no words. Documents without a doc_id lose nothing and take nothing from others. Rows
    that repeat a doc_id are judged each on its own; equal ids take nothing from each other. Other columns are not
    read; an empty table gives an empty one.
    """
    keyed = columns_of(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), text_key(F.col("text")).alias("k"), "text"
    )
    found = earlier_windows(keyed, window, anchor)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for doc, text, marks in zip(part.column("doc_id").to_pylist(), texts(part, "text"), part.column("found").to_pylist(), strict=True):
                    words = text.split()
                    gone = 0
                    if marks:
                        steps = np.zeros(len(words) + 1, np.int64)
                        for x in marks:
                            at = x["at"] + np.nonzero(x["flags"])[0]
                            np.add.at(steps, at, 1)
                            np.add.at(steps, at + window, -1)
                        cover = np.cumsum(steps[:-1]) > 0
                        gone = int(cover.sum())
                        words_kept = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                    else:
                        words_kept = words
                    rows.append((doc, len(words), gone, b" ".join(words_kept).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return keyed.join(found, ["d", "k"], "left").mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept string")

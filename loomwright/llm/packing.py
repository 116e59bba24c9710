"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. There the plan is made:
lengths are indexed by presence, by pair sums and, through the pair index, by triple sums; combinations that
fill a sequence exactly are consumed as often as the availability counts allow, as far as that costs no
sequences, and what is left is placed best-fit, longest first. Every use of a combination exhausts a length, so the plan stays within a few rows per
length however many documents there are. Pieces then find their place by their rank among pieces of equal
length; ranks are counted in salted blocks, so a length that a third of all pieces share is spread out.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import CHUNK_BYTES, columns_of, materialize, pieces, worker_memory

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked together.
BLOCK_ROWS = 1024
#: Parts of the range of lengths after each of which the plan is weighed.
STRETCHES = 8
#: Words that a generation of a worker's memory holds, about, and the longest of them.
CACHE_WORDS, CACHE_WORD_CHARACTERS = 300_000, 64
#: Words whose ids are put in place at once.
GATHER_WORDS = 1 << 18


class WordTokens:
    """Ids of white-space separated words, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in turn. It
    also lower-cases, so words are looked up in lower case. A word of small Latin letters only is one piece to its
    model, which is asked directly; a full stop or comma after it is a piece of its own. All others go through the
    whole tokenizer, many in a call.
    """

    SEPARATOR = "7"
    PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.separator = self._encode(self.SEPARATOR)
        assert len(self.separator) == 4, "the separator has to be a token of its own"
        self.stops = {s: self._encode(s) for s in ".,"}
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # as the model sees them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes_shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _others(self, words: list[str]) -> dict[str, bytes]:
        """Some in a call, with a separator between them; alone, if they hold it or may be special or are long."""
        out, some = {}, []
        for word in words:
            if self.SEPARATOR in word or "<|" in word or len(word) > CACHE_WORD_CHARACTERS:
                out[word] = self._encode(word)
            else:
                some.append(word)
        calls = [some[i : i + 50] for i in range(0, len(some), 50)]
        encoded = self.tokenizer.encode_batch_fast([f" {self.SEPARATOR} ".join(x) for x in calls], add_special_tokens=False)
        mark = np.frombuffer(self.separator, "<u4")[0]
        for call, e in zip(calls, encoded, strict=True):
            got = np.asarray(e.ids, "<u4")
            flat, start = got.tobytes(), 0
            for word, end in zip(call, [*(4 * np.nonzero(got == mark)[0]).tolist(), len(flat)], strict=True):
                out[word] = flat[start:end]
                start = end + 4
        return out

    def lookup(self, words: list[str]) -> list[bytes]:
        """The ids of each of many different words. Two generations are remembered, the older one replaced when full."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        out = list(map(self.known.get, words))
        odd, older, plain = [], self.older, self.PLAIN.fullmatch
        for i, word in enumerate(words):
            if out[i] is None:
                value = older.get(word)
                if value is None:
                    if plain(word):
                        value = self._plain(word)
                    elif word[-1:] in self.stops and plain(word, 0, len(word) - 1):
                        value = self._plain(word[:-1]) + self.stops[word[-1]]
                    else:
                        odd.append(word)
                        continue
                if len(word) <= CACHE_WORD_CHARACTERS:
                    self.known[word] = value
                out[i] = value
        if odd:
            found = self._others(odd)
            self.known.update((w, v) for w, v in found.items() if len(w) <= CACHE_WORD_CHARACTERS)
            out = [found[w] if v is None else v for w, v in zip(words, out, strict=True)]
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids end); null counts as empty."""
        column = pc.fill_null(column, "")
        # Lower-cased, unless a text may spell a special token, whose case counts.
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column)))
        words = split.flatten().dictionary_encode()
        found = self.lookup(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        which = words.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        out = np.empty(ends[-1], "<u4")
        for a in range(0, len(which), GATHER_WORDS):
            own = which[a : a + GATHER_WORDS]
            lo, hi, n = ends[a], ends[a + len(own)], sizes[own]
            out[lo:hi] = flat[np.repeat(starts[own] - (ends[a : a + len(own)] - lo), n) + np.arange(hi - lo)]
        offsets = split.offsets.to_numpy().astype(np.int64)
        return out, ends[offsets[1:] - offsets[0]]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document's ids and the end id, cut at ``capacity``.

    A null text counts as empty and gives one piece that holds the end id. Rows that repeat a doc_id are cut each
    on its own, and rows without one too. Whole texts are tokenised, however long. An empty table gives an empty one.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * keep_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memory(f"tokens {tokenizer_path}", lambda: WordTokens(tokenizer_path))  # its size is bounded
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in pieces(batch, "text", 2 * CHUNK_BYTES):
                rows: list[tuple] = []
                flat, ends = words.ids(part.column("text"))
                first = 0
                for doc, last in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    ids = flat[first:last].tobytes() + end
                    first = last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return columns_of(docs, "doc_id", "text").mapInArrow(cut, ddl)


class _Stock:
    """How many pieces of each length are left, with the index of pair sums of lengths that are left."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        here = (self.left > 0).astype(np.float64)
        size = 2 * capacity + 2
        self.pairs = np.rint(np.fft.irfft(np.fft.rfft(here, size) ** 2, size)).astype(np.int64)[: capacity + 1]

    def rest(self) -> dict[int, int]:
        return {int(x): int(self.left[x]) for x in np.nonzero(self.left)[0]}

    def take(self, lengths: list[int]) -> int:
        """Use up a combination as often as possible; how often that was."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                self.left[x] -= times * n
                if not self.left[x]:
                    here = self.left > 0
                    self.pairs[x:][here[: len(self.pairs) - x]] -= 2
                    if 2 * x < len(self.pairs):
                        self.pairs[2 * x] -= 1
        return times

    def pair(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs of lengths left with this sum, the most uneven first."""
        if total >= 2 and self.pairs[total] > 0:
            here = self.left[1:total] > 0
            for b in (np.nonzero(here & here[::-1])[0] + 1)[::-1]:
                if 2 * b < total:
                    break
                yield int(b), total - int(b)

    def triple(self, total: int) -> Iterator[tuple[int, int, int]]:
        if total >= 3:
            here = (self.left[1 : total - 1] > 0) & (self.pairs[total - 1 : 1 : -1] > 0)
            for c in (np.nonzero(here)[0] + 1)[::-1]:
                for a, b in self.pair(total - int(c)):
                    yield int(c), a, b


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of every kind of sequence; together they hold exactly ``counts``.

    Gaps are closed by single lengths, then by pairs, then by triples, the longest sequences first. Short lengths
    are scarce: used up for exact gaps they are missing where best fit needs them. So after every stretch of lengths
    the residue is packed best-fit, and complements are consumed only as far as the whole plan does not grow: it
    never has more sequences than best fit alone.
    """
    stock, plan = _Stock(counts, capacity), []
    if whole := stock.take([capacity]):
        plan.append((whole, (capacity,)))
    best = plan + _best_fit(stock.rest(), capacity)
    step = -(-capacity // STRETCHES)
    for kinds in (lambda gap: iter([(gap,)]), stock.pair, stock.triple):
        for top in range(capacity - 1, 0, -step):
            before = len(plan)
            _close_gaps(stock, plan, range(top, max(0, top - step), -1), capacity, kinds)
            if len(plan) == before:
                continue
            now = plan + _best_fit(stock.rest(), capacity)
            if _sequences(now) > _sequences(best):
                return best
            best = now
    return best


def _sequences(plan: list[tuple[int, tuple[int, ...]]]) -> int:
    return sum(times for times, _ in plan)


def _close_gaps(stock: _Stock, plan: list[tuple[int, tuple[int, ...]]], lengths: range, capacity: int, kinds: Callable[[int], Iterator[tuple[int, ...]]]) -> None:
    """Consume the combinations that ``kinds`` finds for the gap beside each of ``lengths``, as often as they are there."""
    for length in lengths:
        again = True
        while again and stock.left[length]:
            again = False
            for rest in kinds(capacity - length):
                if times := stock.take([length, *rest]):
                    plan.append((times, (length, *rest)))
                    again = len(rest) > 1
                    break


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each into the fullest sequence that takes it; alike sequences are kept as one entry with a count."""
    room = np.zeros(capacity + 1, np.int64)
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(times: int, lengths: tuple[int, ...]) -> None:
        free = capacity - sum(lengths)
        open_.setdefault(free, []).append((times, lengths))
        room[free] += times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fits = np.nonzero(room[length:])[0]
            if len(fits):
                free = length + int(fits[0])
                times, lengths = open_[free].pop()
                room[free] -= times
            else:
                free, times, lengths = capacity, n, ()
            each = free // length
            full = min(times, n // each)
            if full:
                put(full, lengths + (length,) * each)
            n -= full * each
            if full < times and n:
                put(1, lengths + (length,) * n)
                full, n = full + 1, 0
            if lengths and full < times:
                put(times - full, lengths)
    return [x for free in sorted(open_) for x in open_[free]]


def _places(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """One row per length of each pattern: which ranks of that length it takes, and where they go."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in plan:
        at = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], n, sequence, at))
            used[length] += times * n
            at += length * n
        sequence += times
    rows.sort()
    length, first, each, base, at = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (length << 40) + first, "first": first, "each": each, "base": base, "at": at}


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_`` (doc_id, piece, length, ...) with sequence_id and offset, in as few sequences as the plan finds.

    ``pieces_`` must read the same on each use (a written table does). Pieces that tie are interchangeable; an
    empty table gives an empty one. Offsets leave no gap in a sequence.
    """
    spark = pieces_.sparkSession
    counts = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(_places(plan_patterns(counts, capacity)))
    blocks = max(1, sum(counts.values()) // BLOCK_ROWS)
    salted = pieces_.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("n"))
        .select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    )
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces_.columns]
    ranked = (
        salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
        .select(*[F.col(c) for c in pieces_.columns], "_rank")
    )
    names = pieces_.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        t = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = np.searchsorted(t["key"], (length << 40) + rank, side="right") - 1
            nth = rank - t["first"][row]
            sequence, offset = t["base"][row] + nth // t["each"][row], t["at"][row] + nth % t["each"][row] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{n}` {k}" for n, k in pieces_.dtypes)
    return ranked.mapInArrow(place, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text; other columns are not read)."""
    return pack(materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity)

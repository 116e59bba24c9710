"""Language identification by n-gram filters that hold all languages at once.

The filter is a Bloom filter whose cells are bit sets of languages: a look-up ANDs the cells of an n-gram and
gives every language that may hold it. A document's count for a language is the popcount of its bit over all
n-grams of the whole text, less what the filter's known rate of false positives explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, fresh, mix, pieces, texts, worker_memory

#: About so many labelled documents of a language are learned from, picked by a hash of their ids.
SAMPLE_DOCUMENTS = 2000
#: A language holds an n-gram if it is at least so frequent in it as in the language where it is most frequent.
LEAST_SHARE = 0.1
ORDERS, CELLS, PROBES = (2, 3, 4), 1 << 20, 3
UNKNOWN = "und"
#: Bytes of text that n-grams are made of at once: they take about 200 times the memory.
GRAM_BYTES = 256 << 10
#: A document is rejected where its language knows less of its n-grams than this.
LEAST_COVERAGE = 0.2
#: Languages that the filters have room for: 8 MB for every 64.
MOST_LANGUAGES = 512


def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, count=0x110000)


def gram_hashes(batch: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text index, number of letters by text) of the n-grams of words, with one blank at either end."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in batch]
    sizes = np.array([len(p) for p in points])
    blank = np.zeros(1, np.uint32)
    flat = np.concatenate([x for p in points for x in (blank, p)] + [blank])
    is_letter = letters[flat]
    codes = np.where(is_letter, flat, 0).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(batch) + 1), np.append(sizes + 1, 1))
    counts = np.bincount(owner[is_letter], minlength=len(batch) + 1)[:-1]
    hashes, owners = [], []
    value = codes
    inner = np.ones(len(codes), bool)  # no blank from the second to the last but one
    for n in range(2, max(ORDERS) + 1):
        value = value[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n > 2:
            inner = inner[:-1] & is_letter[n - 2 : len(is_letter) - 1]
        else:
            inner = inner[:-1]
        if n in ORDERS:
            good = inner & (is_letter[: len(inner)] | is_letter[n - 1 :])
            hashes.append(mix(mix(value[good]) + np.uint64(n)))
            owners.append(owner[n - 1 :][good])  # its last character's: the blank before a text belongs to that text
    return np.concatenate(hashes), np.minimum(np.concatenate(owners), len(batch) - 1), counts


def _probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (hashes + np.uint64(i) * step) & np.uint64(CELLS - 1)


@dataclass(frozen=True)
class LanguageFilters:
    """languages in order of their bits; cells: one row of bit sets for every 64 languages."""

    languages: list[str]
    cells: np.ndarray

    def false_rates(self) -> np.ndarray:
        """How often an n-gram that a language does not hold seems to be held, by language."""
        return np.array([float(np.mean((self.cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) ** PROBES for i in range(len(self.languages))])

    def counts(self, hashes: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """Hits by text and language."""
        out = np.zeros((n, len(self.languages)))
        for k, row in enumerate(self.cells):
            mask = np.bitwise_and.reduce([row[p] for p in _probes(hashes)])
            for i in range(64 * k, min(64 * k + 64, len(self.languages))):
                out[:, i] = np.bincount(owners[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=n)
        return out


def learn_filters(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> LanguageFilters:
    """From ``labelled`` (doc_id, text, lang): rows with a null in any of these teach nothing.

    Learns from about ``sample`` documents of each language, all of them where there are fewer.
    """
    labelled = columns_of(labelled, "doc_id", "text", "lang").dropna()
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))  # languages: a few
    chosen = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("n") < sample * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = worker_memory("letters", _letters)
        for batch in batches:
            for part in pieces(batch, "text", GRAM_BYTES):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), texts(part, "text"), strict=True):
                    by.setdefault(lang, []).append(text.decode())
                for lang, own in by.items():
                    grams, n = np.unique(gram_hashes(own, letters)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rates = counted.join(F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("rate", F.col("n") / F.col("total"))
    held = rates.join(rates.groupBy("gram").agg(F.max("rate").alias("top")), "gram").where(F.col("rate") >= LEAST_SHARE * F.col("top"))
    languages = sorted(r["lang"] for r in held.select("lang").distinct().collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the filters are broadcast and hold {MOST_LANGUAGES} at most")
    bit = F.create_map(*[F.lit(x) for pair in zip(languages, range(len(languages)), strict=True) for x in pair]) if languages else F.lit(None)
    low, step = F.col("gram").bitwiseAND(CELLS - 1), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1)).bitwiseAND(CELLS - 1)
    probes = F.array(*[(low + i * step).bitwiseAND(CELLS - 1) for i in range(PROBES)])
    cells = np.zeros((-(-len(languages) // 64), CELLS), np.uint64)
    if languages:
        set_ = held.select(bit[F.col("lang")].alias("bit"), F.explode(probes).alias("cell")).groupBy("cell", F.expr("bit div 64").alias("k"))
        rows = set_.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()  # at most CELLS for 64 languages
        cells[rows["k"].to_numpy(), rows["cell"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return LanguageFilters(languages, cells)


def identify(docs: DataFrame, filters: LanguageFilters, results: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1: the winner's share of all languages' hits) and coverage.

    coverage is the share of the text's n-grams that the predicted language holds. A text that is null or has no
    letter gives ``und``, 0 and 0; ties go to the language that sorts first. Only ``text`` decides; other columns
    pass through, but for ones named like the three results, which are replaced (``results`` gives others names).
    Repeated rows, and rows without an id, are judged each on its own; an empty table gives an empty one.
    """
    docs = docs.drop(*results)
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.cells, filters.false_rates()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, cells, false = model.value
        own, letters = LanguageFilters(languages, cells), worker_memory("letters", _letters)
        for batch in batches:
            for part in pieces(batch, "text", GRAM_BYTES):
                hashes, owners, n_letters = gram_hashes([t.decode() for t in texts(part, "text")], letters)
                total = np.maximum(1, np.bincount(owners, minlength=part.num_rows))[:, None]
                rates = np.zeros((part.num_rows, max(1, len(languages))))
                if languages:
                    hits = own.counts(hashes, owners, part.num_rows)
                    rates = np.clip((hits - total * false) / (1 - np.minimum(false, 0.999)), 0, None) / total
                best, some = rates.argmax(axis=1), (n_letters > 0) & bool(languages)
                top, sums = rates.max(axis=1), rates.sum(axis=1)
                score = np.where(some & (sums > 0), top / np.where(sums > 0, sums, 1), 0.0)
                said = [languages[i] if s else UNKNOWN for i, s in zip(best, some, strict=True)]
                columns = [*[part.column(c) for c in names], pa.array(said, pa.string()), pa.array(score), pa.array(np.where(some, np.minimum(top, 1), 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *results])

    ddl = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(predict, f"{ddl}, `{results[0]}` string, `{results[1]}` double, `{results[2]}` double")


def held_out() -> F.Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, filters: LanguageFilters, least: float = LEAST_COVERAGE) -> DataFrame:
    """``docs`` without those that are in no known language: null and empty texts go, as those without letters.

    All columns pass through, whatever their names.
    """
    lang, score, coverage = fresh(docs, "lang_pred", "score", "coverage")
    said = identify(docs, filters, (lang, score, coverage))
    return said.where((F.col(lang) != UNKNOWN) & (F.col(coverage) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])

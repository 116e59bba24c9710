"""Quotas and splits: how many rows of each class, and which ones.

Only the number of rows of each class reaches the driver; the rows themselves are picked by their rank in a seeded
order, so a smaller request is a prefix of a larger one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import corpus as C

#: Classes that a table may have; their counts are collected.
MOST_CLASSES = 100_000


def active_weights(weights: dict[str, float], known: Iterable[str] | None = None) -> dict[str, float]:
    """Those above zero; unknown names, weights below zero and no weight above zero are errors."""
    if known is not None and (unknown := sorted(set(weights) - set(known))):
        raise ValueError(f"unknown names: {', '.join(unknown)}")
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is below zero")
    if not (active := {k: float(w) for k, w in weights.items() if w > 0}):
        raise ValueError("no weight is above zero")
    return active


def transfer(counts: dict[str, int], capacities: dict[str, int], weights: dict[str, float], amount: int, least_weight: float) -> int:
    """Give ``amount`` more rows to classes of ``least_weight`` or more that have rows left; what nobody could take."""
    while amount > 0:
        free = {k: capacities[k] - counts[k] for k, w in weights.items() if w >= least_weight and w > 0 and capacities[k] > counts[k]}
        if not free:
            break
        lot = min(amount, sum(free.values()))
        amount -= lot
        for k, n in C.largest_remainder({k: weights[k] for k in free}, lot).items():
            took = min(n, free[k])
            counts[k], free[k], lot = counts[k] + took, free[k] - took, lot - took
        while lot:  # rounding and full classes: one row each, the heaviest first
            for k in sorted((k for k in free if free[k]), key=lambda k: (-weights[k], k))[:lot]:
                counts[k], free[k], lot = counts[k] + 1, free[k] - 1, lot - 1
    return amount


def weighted_counts(capacities: dict[str, int], weights: dict[str, float], total: int) -> tuple[dict[str, int], int]:
    """(rows of each class, rows that are missing): shortages move to classes that weigh as much or more only."""
    active = {k: w for k, w in weights.items() if w > 0}
    quotas = C.largest_remainder(active, total) if active and total > 0 else {}
    counts = {k: min(quotas.get(k, 0), capacities.get(k, 0)) for k in weights}
    sizes = {k: capacities.get(k, 0) for k in weights}
    for weight, missing in sorted(((active[k], n - counts[k]) for k, n in quotas.items() if n > counts[k]), reverse=True):
        transfer(counts, sizes, weights, missing, weight)
    return counts, max(0, total - sum(counts.values()))


def class_sizes(df: DataFrame, class_: str) -> dict[str, int]:
    rows = df.groupBy(class_).agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} classes")
    return {r[0]: r["n"] for r in rows}


def configured_class(df: DataFrame, class_: str, names: Iterable[str]) -> DataFrame:
    """Rows of the named classes, under the names' own spelling; upper and lower case are the same."""
    table = df.sparkSession.createDataFrame([(n.lower(), n) for n in {n.lower(): n for n in reversed(list(names))}.values()], "_folded string, _named string")
    return df.withColumn("_folded", F.lower(class_)).join(F.broadcast(table), "_folded").withColumn(class_, F.col("_named")).drop("_folded", "_named")


def is_noise(class_: Column, noise: str) -> Column:
    return F.lower(class_) == noise.lower()


def class_universe(observed: Iterable[str], weights: dict[str, str | float] | None, noise: str, star: float = 0.0) -> list[str]:
    """Classes to draw from: the observed ones that weigh something, and configured ones even without rows.

    ``weights`` may hold a weight for ``*``, which stands for all classes that it does not name.
    """
    weights = weights or {}
    named = {k.lower(): float(w) for k, w in weights.items() if k != "*"}
    rest = float(weights.get("*", star))
    out = {n for n in observed if n.lower() != noise.lower() and named.get(n.lower(), rest) > 0}
    have = {n.lower() for n in out}
    out |= {k for k, w in weights.items() if k != "*" and k.lower() != noise.lower() and float(w) > 0 and k.lower() not in have}
    return sorted(out)


def allowed_repetitions(df: DataFrame, column: str, allowed: Iterable[str] | None) -> DataFrame:
    """Rows of the allowed repetition classes, in any case; no list is no filter, an empty one is an error."""
    if allowed is None:
        return df
    names = sorted({a.strip().lower() for a in allowed if a.strip()})
    if not names:
        raise ValueError("no repetition class is allowed")
    return df.where(F.lower(column).isin(names))


def take(df: DataFrame, class_: str, counts: dict[str, int], *order: Column) -> DataFrame:
    """The first rows of each class by ``order``: as many as ``counts`` says."""
    wanted = {k: n for k, n in counts.items() if n > 0}
    if not wanted:
        return df.limit(0)
    quota = df.sparkSession.createDataFrame(list(wanted.items()), f"{class_} string, _quota long")
    first = C.per_class(df.join(F.broadcast(quota), class_), class_, max(wanted.values()), *order)  # a literal bound: tasks keep no more
    return first.where(F.col("place") <= F.col("_quota")).drop("place", "_quota")


def _preferred(described: Column | None, prefer: bool | None) -> list[Column]:
    return [] if prefer is None or described is None else [F.when(described == prefer, 0).otherwise(1)]


def _with_noise(chosen: DataFrame, noise: DataFrame, missing: int, have: int, key: Column, label: str) -> DataFrame:
    if missing > have:
        raise ValueError(f"{label}: {missing} rows of noise are needed, {have} are there")
    return chosen.unionByName(noise.orderBy(key).limit(missing)) if missing > 0 else chosen


def choose_weighted(df: DataFrame, class_: str, weights: dict[str, float], total: int, key: Column, noise: str = "noise", described: Column | None = None, prefer: bool | None = None) -> DataFrame:
    """``total`` rows by class weights; what classes cannot give comes from noise, in the order of ``key``."""
    sizes = class_sizes(df, class_)
    names = class_universe([k for k in sizes if k is not None], weights, noise)
    rows = configured_class(df, class_, names)
    own = class_sizes(rows, class_) if names else {}
    weight = {n: float(next((w for k, w in weights.items() if k.lower() == n.lower()), weights.get("*", 0.0))) for n in names}
    counts, missing = weighted_counts(own, weight, total)
    have = sum(n for k, n in sizes.items() if k is not None and k.lower() == noise.lower())
    return _with_noise(take(rows, class_, counts, *_preferred(described, prefer), key), df.where(is_noise(F.col(class_), noise)), missing, have, key, "weighted")


def choose_uniform(df: DataFrame, class_: str, total: int, key: Column, noise: str = "noise", described: Column | None = None, prefer: bool | None = None) -> DataFrame:
    """``total`` rows in equal shares of all classes; small classes' shares go to the others, noise comes last."""
    sizes = {k: n for k, n in class_sizes(df, class_).items() if k is not None}
    counts = C.water_fill({k: n for k, n in sizes.items() if k.lower() != noise.lower()}, total)
    have = sum(n for k, n in sizes.items() if k.lower() == noise.lower())
    return _with_noise(take(df, class_, counts, *_preferred(described, prefer), key), df.where(is_noise(F.col(class_), noise)), total - sum(counts.values()), have, key, "uniform")


def choose_per_class(df: DataFrame, class_: str, names: list[str], each: int, extra_noise: int, key: Column, noise: str = "noise", described: Column | None = None, prefer: bool | None = None) -> DataFrame:
    """``each`` rows of every named class, noise for what classes lack, and ``extra_noise`` rows of noise besides."""
    rows = configured_class(df, class_, names)
    own = class_sizes(rows, class_) if names else {}
    counts = {n: min(each, own.get(n, 0)) for n in names}
    missing = sum(each - n for n in counts.values()) + extra_noise
    pool = df.where(is_noise(F.col(class_), noise))
    return _with_noise(take(rows, class_, counts, *_preferred(described, prefer), key), pool, missing, pool.count(), key, "per class")


def without_keys(df: DataFrame, taken: DataFrame, *keys: str) -> DataFrame:
    return df.join(taken.select(*keys), list(keys), "left_anti")


def benchmark_and_rest(df: DataFrame, class_: str, names: list[str], each: int, extra_noise: int, key: Column, keys: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """(the benchmark, all other rows)."""
    chosen = choose_per_class(df, class_, names, each, extra_noise, key, **options)
    return chosen, without_keys(df, chosen, *keys)


def disjoint_union(parts: list[DataFrame], keys: list[str], total: int) -> DataFrame:
    """All parts together; an error if two share a key or their rows are not ``total``."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    rows, different = whole.agg(F.count("*"), F.count_distinct(*keys)).first()
    if rows != different or rows != total:
        raise ValueError(f"{rows} rows with {different} keys, {total} expected")
    return whole


def reinforcement_mix(df: DataFrame, class_: str, repetition: str, weights: dict[str, float], total: int, key: Column, keys: list[str], noise: str = "noise", low_share: float = 0.25) -> DataFrame:
    """A quarter of little repetition and the rest of much, by class weights, together exactly ``total``."""
    low = round(total * low_share)
    first = choose_weighted(allowed_repetitions(df, repetition, ["low"]), class_, weights, low, key, noise)
    rest = choose_weighted(allowed_repetitions(df, repetition, ["high", "critical"]), class_, weights, total - low, key, noise)
    return disjoint_union([first, rest], keys, total)


def weighted_choice(options: dict[str, tuple[Column, float]], u: Column) -> Column:
    """The name of one of the options that has text, drawn by weights with ``u`` in [0, 1); null where none has."""
    there = {name: F.when(T.has_text(value), F.lit(float(w))).otherwise(F.lit(0.0)) for name, (value, w) in options.items()}
    total = sum(there.values(), F.lit(0.0))
    out, so_far = None, F.lit(0.0)
    for name, weight in there.items():
        so_far = so_far + weight
        hit = (weight > 0) & (u * total < so_far)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def stratified_split(df: DataFrame, stratum: str, test_rows: int, *order: Column) -> DataFrame:
    """``df`` with split: ``test_rows`` rows for the test in proportion to the strata's sizes, all others for training."""
    sizes = {k: n for k, n in class_sizes(df.where(F.col(stratum).isNotNull()), stratum).items()}
    whole = sum(sizes.values())
    if test_rows > whole:
        raise ValueError(f"{test_rows} rows for the test of {whole}")
    counts = {k: test_rows * n // whole for k, n in sizes.items()}
    for k in sorted(sizes, key=lambda k: (-(test_rows * sizes[k] % whole), k))[: test_rows - sum(counts.values())]:
        counts[k] += 1
    quota = df.sparkSession.createDataFrame(list(counts.items()), f"{stratum} string, _quota long")
    ranked = C.rank_within(df, [stratum], *order).join(F.broadcast(quota), stratum, "left")
    return ranked.withColumn("split", F.when(F.col("place") <= F.col("_quota"), "test").otherwise("train")).drop("place", "_quota")


def fraction_split(df: DataFrame, fraction: float, *order: Column) -> DataFrame:
    """``df`` with split: the first int(rows * fraction) by ``order`` for training, the others for validation."""
    first = math.floor(df.count() * fraction)
    return C.rank_within(df, [], *order).withColumn("split", F.when(F.col("place") <= first, "train").otherwise("validation")).drop("place")


def three_way(u: Column, original: float, second: float, names: tuple[str, str, str] = ("original", "ultrasketch", "displacement")) -> Column:
    """The first name with probability ``original``, else the second with ``second``, else the third."""
    return F.when(u < original, names[0]).when((u - original) / max(1e-12, 1 - original) < second, names[1]).otherwise(names[2])


def first_successes(df: DataFrame, bucket: list[str], ok: Column, wanted: Column, *order: Column) -> DataFrame:
    """The first ``wanted`` successes of each bucket, in order: what a pool that stops at its target keeps."""
    return C.rank_within(df.where(ok), bucket, *order).where(F.col("place") <= wanted).drop("place")


def interleaved(df: DataFrame, source: str, *order: Column) -> DataFrame:
    """All rows with ``turn``: the first of every source, then the second of every source, and so on."""
    return C.rank_within(df, [source], *order).withColumnRenamed("place", "turn")

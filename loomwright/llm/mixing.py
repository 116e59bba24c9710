"""Document rates that give labelled domains target shares of all tokens.

A naive Bayes classifier on hashed words, learned from the labelled table, gives every document soft membership
of the domains. Rates r >= 0 solve a least-squares problem by projected gradient: the expected tokens of domain
k, sum over d of r_d tokens_d p_dk, shall be its target, errors counted relative to what the domain has. A step
needs one distributed sum per domain; a document's rate follows from its memberships and the steps' gradients, so
no state is written between steps. Only DataFrame functions are used, and no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, fresh, materialize, release

#: Domains, with the shares of all tokens that they shall have.
TARGETS = {"good": 0.84, "plain": 0.14, "toxic": 0.02}
#: Labelled documents that the classifier is learned from, at most about; hashed words; words' worth of evidence.
SAMPLE_DOCUMENTS, BUCKETS, EVIDENCE = 20_000, 1 << 14, 200.0
#: Relative errors at which the targets are met; the share by which the squares have to shrink over so many steps,
#: else they are as good as the least there are; and the most steps. ``residual`` tells what error was left.
TOLERANCE, PROGRESS, WATCHED, STEPS = 1e-4, 0.01, 8, 100
#: Steps after which rates are written; a pass repeats no more than these.
REPLAYED = 8


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain; toxic comes first, then quality. Rows that repeat a doc_id count by their highest marks."""
    marks = columns_of(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return marks.where("quality is not null or toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("plain").alias("domain"))


def _buckets(text: Column) -> Column:
    """The hashed words of a text; nothing for a null or blank one."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\s]+", -1), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))


def learn_domains(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], sample: int = SAMPLE_DOCUMENTS) -> tuple[DataFrame, list[float]]:
    """(bucket with a log likelihood for each domain; log priors). The table has BUCKETS rows at most."""
    known = domain_of(labels)
    total = max(1, known.count())
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * total < sample * 1_000_000)
    seen = columns_of(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", F.explode(_buckets(F.col("text"))).alias("bucket"))
    counts = seen.groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    counts = materialize(counts, "counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(domains))]).first()
    table = counts.select("bucket", *[F.log((F.col(f"n{i}") + 1) / F.lit(float(sums[i] + BUCKETS))).alias(f"w{i}") for i in range(len(domains))])
    had = {r["domain"]: r["n"] for r in some.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a few domains
    return table, [math.log((had.get(d, 0) + 1) / (sum(had.values()) + len(domains))) for d in domains]


def memberships(docs: DataFrame, table: DataFrame, priors: list[float]) -> DataFrame:
    """row, doc_id, text_hash, tokens, p0, p1, ...: words of the whole text, and the posterior of every domain."""
    k = len(priors)
    numbered = columns_of(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
    words = numbered.select("row", "doc_id", "text_hash", F.explode_outer(_buckets(F.col("text"))).alias("bucket"))
    scored = words.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", "text_hash").agg(F.count("bucket").alias("tokens"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)])
    # Long texts count as so many words of evidence at most, which keeps memberships soft.
    weight = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest("tokens", F.lit(1)))
    logits = scored.select("row", "doc_id", "text_hash", "tokens", *[(F.lit(p) + weight * F.col(f"s{i}")).alias(f"z{i}") for i, p in enumerate(priors)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(k)])
    parts = logits.select("row", "doc_id", "text_hash", "tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(k)])
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return parts.select("row", "doc_id", "text_hash", "tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in range(k)])


def fit_rates(members: DataFrame, targets: dict[str, float], downsample: tuple[str, ...] = ("toxic",), steps: int = STEPS) -> DataFrame:
    """``members`` with rate, and residual: the largest relative error of a domain's tokens that is left. The total is such that only domains in ``downsample`` need to lose tokens.

    Steps end where all targets are met or, as no rates may meet them, where the sum of squares hardly shrinks, or
    after ``steps``; a residual above the tolerance says that they were not met. A domain without tokens can't be
    given any and counts as met.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    sums = lambda rated, rate: [v or 0.0 for v in rated.agg(*[F.sum(rate * F.col("tokens") * p[i]) for i in range(k)]).first()]
    at = members.withColumn("rate", F.lit(1.0))
    has = sums(at, F.col("rate"))
    total = max([h / t for (d, t), h in zip(targets.items(), has, strict=True) if d not in downsample and t > 0], default=sum(has))
    goal = [t * total for t in targets.values()]
    past: list[list[float]] = []
    taken = 0
    squares: list[float] = []
    while True:
        off = [(now - want) / h if h else 0.0 for now, want, h in zip(sums(at, _replayed(p, past)), goal, has, strict=True)]
        residual = max(map(abs, off))
        squares.append(sum(h * x * x for h, x in zip(has, off, strict=True)))
        stalled = len(squares) > WATCHED and squares[-1] >= (1 - PROGRESS) * squares[-1 - WATCHED]
        if residual < TOLERANCE or stalled or taken == steps:
            break
        past.append(off)
        taken += 1
        if len(past) == REPLAYED:
            before, at = at, materialize(at.withColumn("rate", _replayed(p, past)), "rates")
            past = []
            if taken > REPLAYED:
                release(before)
    return at.withColumn("rate", _replayed(p, past)).withColumn("residual", F.lit(residual))


def _replayed(p: list[Column], past: list[list[float]]) -> Column:
    """The rate of a document after more steps, whose relative errors ``past`` holds."""
    if not past:
        return F.col("rate")
    steps = F.array(*[F.array(*[F.lit(x) for x in off]) for off in past])
    inner = lambda off: sum((off[i] * p[i] for i in range(1, len(p))), off[0] * p[0])
    return F.aggregate(steps, F.col("rate"), lambda rate, off: F.greatest(F.lit(0.0), rate - inner(off)))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, text_hash, tokens, a posterior p_<domain> for each domain, rate and residual, for every row of ``docs``.

    A null or blank text has no tokens and the prior as its memberships. Rows that repeat a doc_id or have none
    get rates of their own. Without usable labels all memberships are equal. An empty table gives an empty one.
    """
    targets = targets or TARGETS
    table, priors = learn_domains(docs, labels, tuple(targets))
    members = materialize(memberships(docs, table, priors), "memberships")
    rated = fit_rates(members, targets)
    return rated.select("doc_id", "text_hash", "tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(targets)], "rate", "residual")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: its whole part, and once more by a hash of the id.

    Null and empty texts, missing and repeated ids are rated as ``mixing_rates`` says; equal rows have equal rates.
    Other columns pass through, whatever their names. An empty table gives an empty one.
    """
    rated = mixing_rates(docs, labels, targets).groupBy("doc_id", "text_hash").agg(F.max("rate").alias("rate"))  # equal rows have equal rates
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    id_, hash_, times_, nth = fresh(docs, "_mix_id", "_mix_hash", "_mix_times", "_mix_nth")
    times = rated.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.floor(F.col("rate") + draw).cast("int").alias(times_)).where(F.col(times_) > 0)
    same = F.col("`doc_id`").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("`text`")) == F.col(hash_))
    repeated = docs.join(times, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times_))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])

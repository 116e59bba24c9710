"""One query for each operator family, with the SQL that DuckDB runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import corpus as C
from loomwright.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """``t.documents`` reads documents.parquet, and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def cores(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str) -> Callable:
    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


c = F.col
CODE = r"regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')"
HASHED = f"SELECT *, CASE WHEN {CODE} = '' THEN '' ELSE sha256({CODE}) END AS code_hash FROM "
TOKENS = r"regexp_extract_all(text, '\\[A-Za-z@]+|NUM|[A-Za-z_][A-Za-z0-9_]*|--|->|<-|<->|\S')"
GRAMS = "SELECT doc_id, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT doc_id, {tokens} AS t FROM documents), (SELECT unnest({orders}) AS n))"


@query(f"SELECT doc_id, code_hash FROM (SELECT *, row_number() OVER (PARTITION BY code_hash ORDER BY doc_id) AS k FROM ({HASHED} documents)) WHERE (k = 1 OR code_hash = '') AND (code_hash = '' OR code_hash NOT IN (SELECT code_hash FROM ({HASHED} benchmark)))")
def funnel_clean_pool(t: Tables) -> DataFrame:
    pool = C.with_code(t.documents.select("doc_id", "text")).select("doc_id", "code_hash")
    return C.without(C.keep_first(pool, "code_hash", "doc_id"), C.with_code(t.benchmark)).select("doc_id", "code_hash")


@query(f"SELECT count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS rows_removed, count(*) FILTER (n = 2) AS double, count(*) FILTER (n = 3) AS triple, count(*) FILTER (n = 4) AS quadruple, count(*) FILTER (n >= 5) AS five_plus, coalesce(max(n), 1) AS max_multiplicity FROM (SELECT code_hash, count(*) AS n FROM ({HASHED} documents) WHERE code_hash <> '' GROUP BY 1)")
def dup_multiplicity(t: Tables) -> DataFrame:
    return C.multiplicity(C.with_code(t.documents), "code_hash")


@query(f"SELECT count(*) AS matching_hashes, CAST(coalesce(sum(n), 0) AS BIGINT) AS matching_rows FROM (SELECT code_hash, count(*) AS n FROM ({HASHED} documents) WHERE code_hash <> '' GROUP BY 1) WHERE code_hash IN (SELECT code_hash FROM ({HASHED} benchmark))")
def cross_overlap(t: Tables) -> DataFrame:
    sizes = C.with_code(t.documents).where("code_hash <> ''").groupBy("code_hash").agg(F.count("*").alias("n"))
    both = sizes.select("code_hash").intersect(C.with_code(t.benchmark).select("code_hash"))
    return sizes.join(both, "code_hash").agg(F.count("*").alias("matching_hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("matching_rows"))


@query("SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN o_orderdate IS NULL THEN 'invalid' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'wrong_origin' WHEN o_orderdate < TIMESTAMP '1994-01-01' OR o_orderdate > TIMESTAMP '1996-12-31' THEN 'outside_range' END AS reason FROM orders) GROUP BY 1")
def reject_reasons(t: Tables) -> DataFrame:
    day = c("o_orderdate")
    reason = C.reject_reason([("invalid", day.isNull()), ("wrong_origin", ~c("o_orderstatus").isin("O", "F")), ("outside_range", ~day.between(F.lit("1994-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))])
    return t.orders.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN n = 0 THEN 'empty_code' WHEN n > 4096 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS rows_, CAST(max(least(n, 4097)) AS BIGINT) AS maximum_seen FROM (SELECT len({TOKENS}) AS n FROM documents) GROUP BY 1")
def token_filter(t: Tables) -> DataFrame:
    n = F.size(T.tokens(c("text"))).alias("n")
    reason = F.coalesce(C.reject_reason([("empty_code", c("n") == 0), ("too_long", c("n") > 4096)]), F.lit("kept"))
    return t.documents.select(n).groupBy(reason.alias("reason")).agg(F.count("*").alias("rows_"), F.max(F.least("n", F.lit(4097))).cast("long").alias("maximum_seen"))


@query("SELECT doc_id, CASE WHEN k = 1 THEN 's:' || source ELSE 's:' || source || ':' || k || ':' || substr(sha256(text), 1, 8) END AS sample_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def id_disambiguation(t: Tables) -> DataFrame:
    id_ = F.concat(F.lit("s:"), c("source"))
    ranked = C.rank_within(t.documents.select("doc_id", "source", F.substring(F.sha2("text", 256), 1, 8).alias("hash8")), ["source"], c("doc_id")).withColumnRenamed("place", "k")
    return ranked.select("doc_id", F.when(c("k") == 1, id_).otherwise(F.concat_ws(":", id_, c("k"), c("hash8"))).alias("sample_id"))


@query(f"SELECT n, gram, count(*) AS c FROM ({GRAMS.format(tokens=TOKENS, orders='[1, 2, 3, 4]')}) GROUP BY 1, 2 ORDER BY c DESC, n, gram LIMIT 200")
def ngram_topk(t: Tables) -> DataFrame:
    return _top_grams(_tokens(t), (1, 2, 3, 4), 200)


def _tokens(t: Tables) -> DataFrame:
    return C.settled(t.documents.select("doc_id", "text"), "t", T.tokens(c("text"))).select("doc_id", "t")


def _top_grams(tokens: DataFrame, orders: tuple[int, ...], k: int) -> DataFrame:
    """The k most frequent n-grams; those that tie with the last one are spelled too, as texts decide ties."""
    counts = materialize(C.ngram_counts(tokens, "t", orders), "grams")
    last = counts.orderBy(F.desc("c")).limit(k).agg(F.min("c")).first()[0] or 0
    above = counts.where(c("c") > last)
    need = k - above.count()
    # Of the last count only the lowest orders can be among the first k.
    ties = counts.where(c("c") == last).groupBy("n").agg(F.count("*").alias("m")).orderBy("n").collect()
    orders_needed = [r["n"] for i, r in enumerate(ties) if sum(x["m"] for x in ties[:i]) < need]
    wanted = above.unionByName(counts.where((c("c") == last) & c("n").isin(orders_needed)))
    return C.spelled(tokens, "t", wanted, orders).select("n", "gram", "c").orderBy(F.desc("c"), "n", "gram").limit(k)


@query(f"SELECT n, gram, c, place FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, gram) AS place FROM (SELECT n, gram, count(*) AS c FROM ({GRAMS.format(tokens=TOKENS, orders='[1, 2, 3]')}) GROUP BY 1, 2)) WHERE place <= 50")
def ngram_topk_per_order(t: Tables) -> DataFrame:
    grams = C.exploded_ngrams(t.documents.select("doc_id", T.tokens(c("text")).alias("t")), "doc_id", "t", (1, 2, 3))
    counts = grams.groupBy("n", "gram").agg(F.count("*").alias("c"))
    return C.per_class(counts, "n", 50, F.desc("c"), c("gram")).select("n", "gram", "c", "place")


@query(f"SELECT doc_id, round(s, 9) AS repetition_score, CASE WHEN s < .25 THEN 'low' WHEN s < .45 THEN 'medium' WHEN s < .65 THEN 'high' WHEN s < .85 THEN 'very_high' ELSE 'critical' END AS repetition_class FROM (SELECT d.doc_id, coalesce(s, 0.0) AS s FROM documents d LEFT JOIN (SELECT doc_id, CAST(sum(CASE n WHEN 2 THEN .35 WHEN 3 THEN .30 ELSE .20 END * v) / 1.05 AS DOUBLE) AS s FROM (SELECT doc_id, n, sum(CASE WHEN k >= 3 THEN k ELSE 0 END)::DOUBLE / sum(k) AS v FROM (SELECT doc_id, n, gram, count(*) AS k FROM ({GRAMS.format(tokens=TOKENS, orders='[2, 3, 4, 6]')}) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) x USING (doc_id))")
def repetition_class(t: Tables) -> DataFrame:
    scored = C.repetition(t.documents.select("doc_id", T.tokens(c("text")).alias("t")).repartition(t.cores), "doc_id", "t")
    return scored.withColumn("repetition_score", F.round("repetition_score", 9))


@query(f"WITH g AS ({GRAMS.format(tokens=TOKENS, orders='[1, 2]')}), top AS (SELECT n, gram FROM (SELECT n, gram, count(*) AS c FROM g GROUP BY 1, 2) ORDER BY c DESC, n, gram LIMIT 100) SELECT n, sum(CASE WHEN (n, gram) IN (SELECT (n, gram) FROM top) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS coverage FROM g GROUP BY ROLLUP (n)")
def filter_coverage(t: Tables) -> DataFrame:
    counts = C.exploded_ngrams(t.documents.select("doc_id", T.tokens(c("text")).alias("t")), "doc_id", "t", (1, 2)).groupBy("n", "gram").agg(F.count("*").alias("k"))
    top = counts.orderBy(F.desc("k"), "n", "gram").limit(100).select("n", "gram", F.lit(1).alias("common"))
    return counts.join(F.broadcast(top), ["n", "gram"], "left").rollup("n").agg((F.sum(c("k") * F.coalesce("common", F.lit(0))) / F.sum("k")).alias("coverage"))  # 100 rows


@query(r"WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))), r AS (SELECT doc_id, line, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS run FROM l) SELECT doc_id, max(n) AS longest_run, 1 - count(DISTINCT line)::DOUBLE / sum(n) AS repeat_ratio FROM (SELECT doc_id, line, run, count(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1")
def line_runs(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(T.lines(c("text"))).alias("i", "line"))
    run = c("i") - F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("i"))
    runs = lines.withColumn("run", run).groupBy("doc_id", "line", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id").agg(F.max("n").alias("longest_run"), (1 - F.count_distinct("line") / F.sum("n")).alias("repeat_ratio"))


@query("SELECT lang, count(*) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, min(n_chars) AS least, quantile_cont(n_chars, .25) AS q25, quantile_cont(n_chars, .5) AS q50, quantile_cont(n_chars, .75) AS q75, max(n_chars) AS most FROM documents GROUP BY 1")
def class_stats(t: Tables) -> DataFrame:
    n = c("n_chars")
    quantiles = [F.percentile(n, p).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("least"), *quantiles, F.max(n).alias("most"))


@query("SELECT lang, source, CAST(grouping(lang) AS BIGINT) AS g_lang, CAST(grouping(source) AS BIGINT) AS g_source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def split_counts(t: Tables) -> DataFrame:
    sets = t.documents.groupingSets([[c("lang"), c("source")], [c("lang")], []], "lang", "source")
    return sets.agg(F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"), F.count("*").alias("n"))


@query("SELECT d.doc_id, lang, source, quality, toxic, (quality IS NOT NULL) AS described FROM documents d LEFT JOIN labels USING (doc_id)")
def metadata_join(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic", c("quality").isNotNull().alias("described"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS answers FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE answers >= 3 AND (l_quantity >= 25 OR l_linenumber = 1)")
def qa_join(t: Tables) -> DataFrame:
    complete = t.lineitem.withColumn("answers", F.count("*").over(Window.partitionBy("l_orderkey"))).where((c("answers") >= 3) & ((c("l_quantity") >= 25) | (c("l_linenumber") == 1)))
    return complete.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT s_suppkey AS id_a, c_custkey AS id_b, CAST(bit_count(xor(s_suppkey, c_custkey)) AS INTEGER) AS distance FROM supplier, customer WHERE bit_count(xor(s_suppkey, c_custkey)) <= 2")
def hamming_pairs(t: Tables) -> DataFrame:
    key = lambda df, k: df.select(c(k).alias("id"), c(k).alias("hash"))
    return C.hamming_pairs(key(t.supplier, "s_suppkey"), key(t.customer, "c_custkey"))


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text) AND b.text <> ''")
def containment_hits(t: Tables) -> DataFrame:
    # Inner words of an item are whole words wherever it is contained, so a run of them is the key of an equi-join.
    words = lambda s: F.filter(F.split(s, r"\s+", -1), lambda w: w != "")
    items = t.benchmark.where("text <> ''").select("item_id", c("text").alias("item"), words(c("text")).alias("w"))
    keyed = items.where(F.size("w") >= 7).select("item_id", "item", F.xxhash64(F.array_join(F.slice("w", 2, 5), " ")).alias("key"))
    split = C.settled(t.documents.select("doc_id", "text"), "w", words(c("text"))).select("doc_id", "w")
    docs = split.select("doc_id", F.explode(F.array_distinct(C.ngrams(c("w"), 5))).alias("gram")).select("doc_id", F.xxhash64("gram").alias("key"))
    met = docs.join(keyed, "key").select("doc_id", "item_id", "item").distinct()
    long_ = met.join(t.documents.select("doc_id", "text"), "doc_id")
    short = t.documents.select("doc_id", "text").join(items.where(F.size("w") < 7).select("item_id", "item"), F.contains(c("text"), c("item")))
    return long_.where(F.contains("text", "item")).select("doc_id", "item_id").union(short.select("doc_id", "item_id"))


KEY = "md5(concat_ws('|', '42', doc_id))"


@query(f"SELECT doc_id, lang, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {KEY}) AS place FROM documents) WHERE place <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 30 WHEN 'de' THEN 20 ELSE 10 END")
def quota_weighted(t: Tables) -> DataFrame:
    quota = t.spark.createDataFrame(list(C.largest_remainder({"en": 4, "fr": 3, "de": 2, "es": 1}, 100).items()), "lang string, quota long")
    drawn = t.documents.join(F.broadcast(quota), "lang")  # a row for each class
    return C.per_class(drawn, "lang", c("quota"), T.shuffle_key(42, c("doc_id"))).select("doc_id", "lang", "place")


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {KEY}) AS place FROM documents) ORDER BY place, lang LIMIT 120")
def quota_uniform(t: Tables) -> DataFrame:
    ranked = C.per_class(t.documents, "lang", 120, T.shuffle_key(42, c("doc_id")))
    return ranked.orderBy("place", "lang").limit(120).select("doc_id", "lang")


@query(f"SELECT source, doc_id, place FROM (SELECT d.doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (quality IS NOT NULL) DESC, {KEY.replace('doc_id', 'd.doc_id')}) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE place <= 5")
def per_class_topn(t: Tables) -> DataFrame:
    described = t.documents.join(t.labels, "doc_id", "left").withColumn("described", c("quality").isNotNull())
    return C.per_class(described, "source", 5, F.desc("described"), T.shuffle_key(42, c("doc_id"))).select("source", "doc_id", "place")


@query(f"WITH v AS (SELECT doc_id FROM documents ORDER BY {KEY} LIMIT 50), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v) ORDER BY {KEY} LIMIT 200) SELECT doc_id, 'validation' AS split FROM v UNION ALL SELECT doc_id, 'train' FROM r UNION ALL SELECT doc_id, 'metric' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v) AND doc_id NOT IN (SELECT doc_id FROM r)")
def split_cascade(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id")
    take = lambda df, n: df.orderBy(T.shuffle_key(42, c("doc_id"))).limit(n)
    validation = take(ids, 50)
    train = take(ids.join(validation, "doc_id", "left_anti"), 200)
    rest = ids.join(validation, "doc_id", "left_anti").join(train, "doc_id", "left_anti")
    return validation.withColumn("split", F.lit("validation")).union(train.withColumn("split", F.lit("train"))).union(rest.withColumn("split", F.lit("metric")))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders")
def curriculum_sort(t: Tables) -> DataFrame:
    level = F.when(c("o_orderpriority") == "5-LOW", 0).when(c("o_orderpriority") == "2-HIGH", 1).when(c("o_orderpriority") == "1-URGENT", 2).otherwise(3)
    return C.places(t.orders, level, "o_orderkey").select("o_orderkey", "o_orderpriority", "place")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t: Tables) -> DataFrame:
    a = t.embeddings.select(c("vec_id").alias("a"), C.unit(c("embedding")).alias("u"))
    b = t.embeddings.select(c("vec_id").alias("b"), (c("vec_id") - 1).alias("a"), C.unit(c("embedding")).alias("v"))
    return a.join(b, "a").select("a", "b", F.round(C.dot(c("u"), c("v")), 6).alias("cosine"))


@query("SELECT a.doc_id, round(1 / (1 + abs(length(a.text) - length(b.text))::DOUBLE / length(b.text)), 9) AS similarity FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE length(b.text) > 0")
def rel_length(t: Tables) -> DataFrame:
    other = t.documents.select((c("doc_id") - 1).alias("doc_id"), c("text").alias("reference"))
    return t.documents.join(other, "doc_id").select("doc_id", F.round(C.length_similarity(c("text"), c("reference")), 9).alias("similarity"))


@query("SELECT event_id, least(1.0, greatest(0.0, v)) AS score, least(1.0, greatest(0.0, v)) >= threshold AS pass FROM (SELECT event_id, event_type, CAST(value / 100 AS DOUBLE) AS v FROM events) JOIN (VALUES ('click', .75::DOUBLE), ('view', .6::DOUBLE), ('purchase', .8::DOUBLE)) x(event_type, threshold) USING (event_type)")
def clamp_threshold(t: Tables) -> DataFrame:
    limits = t.spark.createDataFrame([("click", 0.75), ("view", 0.6), ("purchase", 0.8)], "event_type string, threshold double")
    score = C.clamp(c("value") / 100)
    return t.events.join(F.broadcast(limits), "event_type").select("event_id", score.alias("score"), (score >= c("threshold")).alias("pass"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN -2.0::DOUBLE ELSE 1 + greatest(-2.0::DOUBLE, least(1.0::DOUBLE, 1 - .10::DOUBLE * l_linenumber - .05::DOUBLE * l_quantity - .01::DOUBLE * l_linenumber)) + 3 * l_discount + .5::DOUBLE * l_tax END, 9) + 0.0::DOUBLE AS reward FROM lineitem")
def reward_total(t: Tables) -> DataFrame:
    diagnostic = C.diagnostic_reward(c("l_linenumber"), c("l_quantity"), c("l_linenumber"))
    reward = C.total_reward(c("l_returnflag") != "R", diagnostic, c("l_discount"), c("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.round(reward, 9) + 0.0).alias("reward"))


@query("SELECT event_type, metric, round(avg(x), 9) AS mean FROM (SELECT event_type, 'value' AS metric, value AS x FROM events UNION ALL SELECT event_type, 'user', user_id::DOUBLE FROM events) WHERE x IS NOT NULL GROUP BY 1, 2")
def metric_rollup(t: Tables) -> DataFrame:
    means = t.events.groupBy("event_type").agg(F.avg("value").alias("value"), F.avg("user_id").alias("user"))
    long_ = means.unpivot("event_type", ["value", "user"], "metric", "mean")
    return long_.where("mean is not null").withColumn("mean", F.round("mean", 9))


@query("WITH m AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1), b AS (SELECT min(q) AS q0, max(q) AS q1, min(d) AS d0, max(d) AS d1 FROM m) SELECT l_suppkey, round(((q - q0) / (q1 - q0) + 1 - (d - d0) / (d1 - d0)) / 2, 9) AS combined FROM m, b")
def minmax_combined(t: Tables) -> DataFrame:
    means = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    ends = means.agg(F.min("q").alias("q0"), F.max("q").alias("q1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    score = ((c("q") - c("q0")) / (c("q1") - c("q0")) + 1 - (c("d") - c("d0")) / (c("d1") - c("d0"))) / 2
    return means.crossJoin(F.broadcast(ends)).select("l_suppkey", F.round(score, 9).alias("combined"))  # one row


@query("SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean_value, max(value) AS max_value, arg_max(event_id, (value, -event_id)) AS at FROM events GROUP BY 1")
def step_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean_value"), F.max("value").alias("max_value"), F.max_by("event_id", F.struct(c("value"), -c("event_id"))).alias("at"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(t: Tables) -> DataFrame:
    n = F.sum("l_quantity")
    mean = F.when(n == 0, F.raise_error(F.lit("no tokens"))).otherwise(F.sum(c("l_extendedprice") * c("l_quantity")) / n)
    return t.lineitem.groupBy("l_returnflag").agg(F.round(mean, 4).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def best_candidate(t: Tables) -> DataFrame:
    return C.per_class(t.lineitem, "l_orderkey", 1, F.desc("l_quantity"), c("l_linenumber")).select("l_orderkey", "l_linenumber", "l_quantity")


@query(r"SELECT page_id, CAST(i AS INTEGER) AS i, block FROM (SELECT page_id, unnest(range(0, len(b))) AS i, unnest(b) AS block FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages))")
def html_blocks(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("i", "block"))


@query(r"SELECT doc_id, CASE WHEN regexp_extract(text, '(?is)```(?:latex|tex|tikz)?\s*(.*?)```', 1) <> '' THEN regexp_replace(regexp_extract(text, '(?is)```(?:latex|tex|tikz)?\s*(.*?)```', 1), '^\s+|\s+$', '', 'g') WHEN regexp_extract(text, '(?is)\\documentclass.*?\\end\{document\}', 0) <> '' THEN regexp_extract(text, '(?is)\\documentclass.*?\\end\{document\}', 0) ELSE regexp_extract(text, '(?is)\\begin\{tikzpicture\}.*?\\end\{tikzpicture\}', 0) END AS code FROM documents")
def fence_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.fenced_block(c("text")).alias("code"))


@query("SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def schema_drift_union(t: Tables) -> DataFrame:
    return t.documents.select(c("doc_id").alias("id"), "text", "lang").unionByName(t.benchmark.select(c("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("SELECT doc_id, length(text) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS the FROM documents")
def structure_counts(t: Tables) -> DataFrame:
    lines = F.size(F.filter(T.lines(c("text")), lambda x: F.trim(x) != "")).cast("long")
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), lines.alias("lines"), T.occurrences(c("text"), "the").alias("the"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'class') AS slug, regexp_replace(regexp_replace(lower(trim(p_type)), '[-_]+', ' ', 'g'), ' +', ' ', 'g') AS label FROM part")
def slugs_and_labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.slug(c("p_type")).alias("slug"), T.canonical_label(c("p_type")).alias("label"))


@query("SELECT doc_id, md5(concat_ws('|', '43', doc_id)) AS k, ('0x' || substr(md5(concat_ws('|', '43', doc_id)), 1, 8))::BIGINT / 4294967296.0 < 0.5 AS first_half FROM documents")
def hash_shuffle(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.shuffle_key(43, c("doc_id")).alias("k"), (T.uniform(43, c("doc_id")) < 0.5).alias("first_half"))


@query("SELECT doc_id, substr(text, CAST(1 + ('0x' || substr(md5(concat_ws('|', doc_id, '1')), 1, 8))::BIGINT % (greatest(length(text) - 50, 0) + 1) AS INTEGER), 50) AS part FROM documents")
def random_substrings(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.random_substring(c("text"), c("doc_id"), 1).alias("part"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.select("o_custkey"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("SELECT doc_id, source || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 8, '0') AS name FROM documents")
def running_numbers(t: Tables) -> DataFrame:
    ranked = C.rank_within(t.documents.select("doc_id", "source"), ["source"], c("doc_id"))
    return ranked.select("doc_id", F.concat(c("source"), F.lit("_"), F.lpad(c("place").cast("string"), 8, "0")).alias("name"))


@query("SELECT doc_id, k, CAST((k - 1) // 4 + 1 AS BIGINT) AS step, CAST((k - 1) % 4 + 1 AS BIGINT) AS slot FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def step_slots(t: Tables) -> DataFrame:
    ranked = C.rank_within(t.documents.select("doc_id", "source"), ["source"], c("doc_id"))
    return ranked.select("doc_id", c("place").cast("long").alias("k")).select("doc_id", "k", F.expr("(k - 1) div 4 + 1").alias("step"), F.expr("(k - 1) % 4 + 1").alias("slot"))


@query(f"SELECT doc_id, 1 - count(DISTINCT gram)::DOUBLE / count(*) AS repeats FROM ({GRAMS.format(tokens=TOKENS, orders='[16]')}) GROUP BY 1")
def sliding_repeats(t: Tables) -> DataFrame:
    # Within a row: no shuffle of n-grams.
    grams = C.settled(t.documents.select("doc_id", "text"), "t", T.tokens(c("text"))).select("doc_id", C.ngrams(c("t"), 16).alias("g")).where(F.size("g") > 0)
    return grams.select("doc_id", (1 - F.size(F.array_distinct("g")) / F.size("g")).alias("repeats"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source")
def class_distribution(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT vec_id, CASE WHEN label = 0 THEN 'noise' ELSE 'class_' || label END AS name FROM embeddings")
def cluster_names(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.when(c("label") == 0, "noise").otherwise(F.concat(F.lit("class_"), c("label"))).alias("name"))


@query("SELECT label, count(*) AS n, round(avg(list_sum(embedding::DOUBLE[])), 6) AS mean_sum FROM embeddings GROUP BY 1")
def pooled_vectors(t: Tables) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 6).alias("mean_sum"))


@query("")
def token_edit_distance(t: Tables) -> DataFrame:
    tokens = T.tokens(T.strip_comments(F.coalesce("text", F.lit(""))))
    other = t.documents.select((c("doc_id") - 1).alias("doc_id"), tokens.alias("reference"))
    return C.token_edit_distance(t.documents.select("doc_id", tokens.alias("output")).join(other, "doc_id"), "doc_id", "output", "reference")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_top_up(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, k <= n // 2 AS first_half FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', doc_id))) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def exact_halves(t: Tables) -> DataFrame:
    ranked = C.rank_within(t.documents.select("doc_id", "lang"), ["lang"], T.shuffle_key(42, c("doc_id"))).withColumnRenamed("place", "k")
    sizes = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(sizes), ranked["lang"].eqNullSafe(sizes["lang"])).select("doc_id", (c("k") <= F.expr("n div 2")).alias("first_half"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def prompt_records(t: Tables) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(turns["role"], ",").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, ts, epoch_us(ts) AS micros, strftime(ts, '%y%m') AS yymm FROM events")
def dates(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", F.unix_micros(c("ts").cast("timestamp")).alias("micros"), F.date_format("ts", "yyMM").alias("yymm"))


@query("SELECT doc_id, CAST(length(text) // 2 AS BIGINT) AS token_proxy, length(text) // 2 < 8192 AS fits, trim(coalesce(text, '')) <> '' AS has_text FROM documents")
def token_proxy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.expr("length(text) div 2").cast("long").alias("token_proxy"), F.expr("length(text) div 2 < 8192").alias("fits"), T.has_text(c("text")).alias("has_text"))


@query("SELECT doc_id, 'Write about ' || source || '.' || CASE WHEN quality = 1 THEN ' Described.' ELSE '' END AS prompt FROM documents LEFT JOIN labels USING (doc_id)")
def prompts(t: Tables) -> DataFrame:
    suffix = F.when(c("quality") == 1, " Described.").otherwise("")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.concat(F.lit("Write about "), c("source"), F.lit("."), suffix).alias("prompt"))

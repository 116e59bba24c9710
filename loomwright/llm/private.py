"""Personal data: base patterns, and terms that reveal what the patterns found.

A protected entity is an identifier that a base pattern finds (its kind and value). Terms are the words of a
document that holds it, wherever they stand, but for those of identifiers. Over all documents, the pointwise mutual
information of a term and an entity says how much of the entity's information content the term gives away:
PMI(t; e) / IC(e) is 1 where the term never occurs without the entity. Terms whose disclosure reaches a threshold
get spans wherever they occur, also in documents without the entity: ``sanitised`` generalises them, and removes
those beyond a higher threshold. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, materialize

#: Base patterns, in the order of their kinds. Possessive quantifiers and the look-behinds change no match (a match
#: starts at the first character of a run, or where the last match ended); they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
TERM, WORD = "term", r"\p{L}++"
#: Every text with a valid match has one of these; few others have.
HINT = r"[@+]|[0-9](?:\.[0-9]++){3}|(?:[0-9][\x20-]?){11}[0-9]"
#: Characters on either side of an identifier that tell its contexts apart.
CONTEXT = 120
#: A term is generalised from the first share of an entity's information on, and removed from the second on.
DISCLOSURE, REMOVAL = 0.8, 0.95
#: Documents, and different contexts, in which a term and an entity have to be seen together.
SUPPORT = 2
#: Terms that are broadcast at once, about 100 bytes each; more take another pass over the texts.
MOST_TERMS = 300_000


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.length(digits).between(12, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def _pieces(text: Column, pattern: str) -> Column:
    """(match, length of the text before it, hash of its context, whether matches cut that short) for every match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    after = F.slice(between, F.lit(2), F.size(between))
    # The arrays are made once a row; named inside the lambda they would be made again for every match.
    both = F.arrays_zip(found.alias("m"), between.alias("b"), after.alias("a"), F.slice(between, F.lit(3), F.size(between)).alias("more"))
    context = lambda x: F.xxhash64(F.right(x["b"], F.lit(CONTEXT)), F.lower(x["m"]), F.left(x["a"], F.lit(CONTEXT)))
    short = lambda x, i: ((i > 0) & (F.length(x["b"]) < CONTEXT)) | (x["more"].isNotNull() & (F.length(x["a"]) < CONTEXT))
    piece = lambda x, i: F.struct(x["m"].alias("value"), F.length(x["b"]).cast("long").alias("gap"), context(x).alias("context"), short(x, i).alias("short"))
    cut = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), piece)
    return F.when(text.rlike(pattern), cut)


def _words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, written once: numbers dealt again need not agree where rows come from a shuffle."""
    return materialize(columns_of(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")


def base_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, value, context of each valid match in ``numbered`` rows; also one row without a kind a document.

    A context that a neighbouring match cuts short is told apart by the whole text. Offsets count code points, ends are exclusive. ``row`` tells rows apart that repeat a doc_id or have none.
    """
    text = F.col("text")
    hints = {"email": text.contains("@"), "phone": text.contains("+")}
    found = docs.select(
        "row", "doc_id", F.xxhash64("text").alias("whole"),
        F.filter(
            F.array(
                F.struct(F.lit(None).cast("string").alias("kind"), F.when(F.lit(False), _pieces(text, CARD)).alias("found")),
                *[F.struct(F.lit(k).alias("kind"), F.when(hints.get(k, F.lit(True)), _pieces(text, p)).alias("found")) for k, p in KINDS.items()],
            ),
            lambda x: x["kind"].isNull() | x["found"].isNotNull(),
        ).alias("kinds"),
    )
    flat = found.select("row", "doc_id", "whole", F.explode("kinds").alias("k")).select("row", "doc_id", "whole", "k.kind", F.posexplode_outer("k.found").alias("i", "m"))
    flat = flat.select("row", "doc_id", "whole", "kind", "i", "m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i")
    length = F.length("value")
    ended = F.sum(F.col("gap") + length).over(before)
    return (
        flat.withColumn("end", ended)
        .withColumn("start", F.col("end") - length)
        .where(F.col("kind").isNull() | _valid(F.col("kind"), F.col("value")))
        .select("row", "doc_id", "kind", "start", "end", "value", F.when(F.col("short"), F.xxhash64("context", "whole")).otherwise(F.col("context")).alias("context"))
    )


def disclosing_terms(docs: DataFrame, base: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """row, doc_id, start, end, disclosure of every occurrence of a word that reveals an entity.

    Counts are of documents, over the whole corpus; a pair has to be seen in ``support`` documents and
    different contexts of the entity, so copies of one document are no evidence.
    """
    hit = base.where("kind is not null").withColumn("e", F.xxhash64("kind", F.lower("value")))
    entities = hit.groupBy("e").agg(F.countDistinct("row").alias("n_entity"), F.countDistinct("context").alias("n_contexts")).where(F.least("n_contexts", "n_entity") >= support)
    # More contexts of a row than ``support`` change nothing: they are asked to be so many at least.
    by_entity = hit.groupBy("row", "e").agg(F.collect_set("value").alias("values"), F.slice(F.sort_array(F.collect_set("context")), 1, support).alias("contexts"))
    asked = by_entity.join(entities.select("e", F.lit(True).alias("asked")), "e", "left")
    held = asked.groupBy("row").agg(F.flatten(F.collect_list("values")).alias("values"), F.collect_list(F.when(F.col("asked"), F.struct("e", "contexts"))).alias("seen"))
    # The longest first: one may be a part of another.
    long_first = F.transform(F.sort_array(F.transform("values", lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), lambda x: x["v"])
    held = materialize(held.where(F.size("seen") > 0).select("row", long_first.alias("values"), "seen"), "held")

    bare = F.aggregate("values", F.col("text"), lambda text, value: F.replace(text, value, F.lit(" ")))
    met = docs.where(F.col("text").rlike(HINT)).join(held, "row").select("row", "seen", F.explode(_words(bare)).alias("term"))
    met = met.select("row", "term", F.explode("seen").alias("s")).select("row", "term", "s.e", F.explode("s.contexts").alias("context"))
    pairs = met.groupBy("term", "e").agg(F.countDistinct("row").alias("n_both"), F.countDistinct("context").alias("n_contexts")).where(F.least("n_contexts", "n_both") >= support)
    terms = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = base.where("kind is null").agg(F.count("*").alias("n_all"))
    scored = (
        pairs.join(entities, "e").join(terms, "term").crossJoin(F.broadcast(total))  # one row
        .withColumn("information", F.log2(F.col("n_all") / F.col("n_entity")))
        .withColumn("disclosure", F.when(F.col("information") > 0, F.log2(F.col("n_both") * F.col("n_all") / (F.col("n_term") * F.col("n_entity"))) / F.col("information")))
        .where(F.col("disclosure") >= threshold)
    )
    scored = materialize(scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "terms")

    # Texts stay where they are: terms are broadcast, in as many passes as they need, and a marked word is looked up in
    # the text at hand. It stands first in its pattern, so that the search is for a literal; the letter beyond the basic
    # plane makes the look-behind step by code points.
    parts = max(1, -(-scored.count() // MOST_TERMS))
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")
    alone = F.concat("word", F.lit("(?<![\\p{L}\U0001d49c]"), "word", F.lit(r")(?!\p{L})"))
    before = F.transform(F.split("text", alone, -1), F.length)
    passes = []
    for k in range(parts):
        part = F.broadcast(scored.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k))
        marked = docs.select("row", "doc_id", "text", words).withColumn("term", F.lower("word")).join(part, "term")
        passes.append(marked.select("row", "doc_id", "word", "disclosure", F.posexplode(F.slice(before, F.lit(1), F.size(before) - 1)).alias("i", "gap")))
    size = F.length("word").cast("long")
    own = reduce(DataFrame.unionByName, passes).withColumn("end", F.sum(F.col("gap") + size).over(Window.partitionBy("row", "word").orderBy("i")))
    return own.select("row", "doc_id", (F.col("end") - size).alias("start"), "end", "disclosure")


def find_private(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """row, doc_id and spans: an array of (start, order, kind, end, disclosure), sorted, for each document.

    A null text counts as empty. Rows that repeat a doc_id or have none are judged each on its own. Base spans
    stay as the patterns find them, kind by kind; a term inside one is dropped. An empty table gives an empty one.
    """
    return spans_of(numbered(docs), threshold, support)


def spans_of(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """As ``find_private``, for the rows of ``numbered``."""
    base = materialize(base_spans(docs), "spans")
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    span = lambda kind, disclosure: F.when(kind.isNotNull(), F.struct("start", order.alias("order"), kind.alias("kind"), "end", disclosure.alias("disclosure")))
    every = base.select("row", "doc_id", span(F.col("kind"), F.lit(None).cast("double")).alias("s")).unionByName(
        disclosing_terms(docs, base, threshold, support).withColumn("kind", F.lit(TERM)).select("row", "doc_id", span(F.col("kind"), F.col("disclosure")).alias("s"))
    )
    spans = every.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    own = F.filter("spans", lambda s: s["kind"] != TERM)
    apart = lambda t: ~F.exists(own, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return spans.select("row", "doc_id", F.filter("spans", lambda s: (s["kind"] != TERM) | apart(s)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, threshold: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """doc_id and text with identifiers replaced by their kinds, disclosing terms generalised or removed.

    Rows are treated as by ``find_private``; a null text stays null.
    """
    docs = numbered(docs)
    found = spans_of(docs, threshold).select("row", F.col("spans").alias("s"))
    text, s = F.coalesce("text", F.lit("")), F.col("s")
    # A span that starts inside an earlier one (of another kind) only extends it.
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda x: x["end"])), F.lit(0).cast("long"))
    put = lambda x: F.when(x["kind"] != TERM, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["disclosure"] < removal, F.lit("[TERM]")).otherwise(F.lit(""))
    piece = lambda x, i: F.when(x["start"] >= reach(i), F.concat(F.substring(text, (reach(i) + 1).cast("int"), (x["start"] - reach(i)).cast("int")), put(x))).otherwise(F.lit(""))
    body = F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, (reach(F.size(s)) + 1).cast("int"), F.length(text)))
    return docs.join(found, "row", "left").select("doc_id", F.when(F.size(s) > 0, body).otherwise(F.col("text")).alias("text"))

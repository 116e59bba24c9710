"""The stages of corpus_pipeline.py on an awkward table, each against a small restatement or its invariants."""

import itertools
import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _line_d int, row string"


def rows():
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("the", "and", "house", "river", "stone") for b in ("", "s", "ing", "er")]
    text = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(n))
    base = [text(r.randint(1, 6)) for _ in range(20)]
    texts = [*base, *base[:3], base[3] + " more", None, "", "  ", "12 34 !!", base[4] + "\n" + text(2)]
    out = [(i, t, "en", "x", None if t is None else len(t), "s", i, None) for i, t in enumerate(texts)]
    return [*out, (5, base[5], "en", None, None, None, None, "r"), (None, text(3), None, "x", 3, "s", 1, "r"), (90, "die stra\u00dfe und der hund sind hier " * 5, "de", "y", 9, "s", 1, "r")]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def labels(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_stages(spark, tmp_path):
    labels(spark, tmp_path)
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = stage("language ID")(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter(tuple(x) for x in kept.collect()) == Counter(tuple(x) for x in rows() if x[1] and any(c.isalpha() for c in x[1]))
    lined = stage("line dedup")(spark, kept, str(tmp_path))
    assert lined.columns == docs.columns
    seen, gone = set(), 0
    for x in sorted((x for x in kept.collect() if x.doc_id is not None), key=lambda x: x.doc_id):
        gone += sum(line in seen for line in x.text.split("\n"))
        seen |= set(x.text.split("\n"))
    assert gone and all(n == 1 for n in Counter(line for x in lined.collect() if x.doc_id is not None for line in {x.doc_id: x.text}[x.doc_id].split("\n")).values() if n > 2)
    apart = stage("n-gram Jaccard join")(spark, kept, str(tmp_path))
    assert apart.columns == docs.columns
    sets = {x.doc_id: {tuple(x.text.lower().split()[k : k + 5]) for k in range(len(x.text.split()) - 4)} for x in kept.collect()}
    part = {i: i for i in sets if i is not None}
    for a, b in itertools.combinations(sorted(part), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((part[a], part[b]))
            part = {i: low if p == high else p for i, p in part.items()}
    want = {i for i, p in part.items() if i == p} | {None}
    assert {x.doc_id for x in apart.collect()} == want
    mixed = stage("mixing sources to target weights")(spark, apart, str(tmp_path))
    assert mixed.columns == docs.columns and {x.doc_id for x in mixed.collect()} <= want
    packed = stage("best-fit packing")(spark, apart, str(tmp_path)).collect()
    by = defaultdict(list)
    for x in packed:
        by[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in v) <= 4096 and all(o == sum(n for p, n in v if p < o) for o, _ in v) for v in by.values())
    assert {x.doc_id for x in packed} == want


def test_stages_on_nothing(spark, tmp_path):
    labels(spark, tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert name == "best-fit packing" or out.columns == docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    whole = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 100 and whole.agg(F.max("n")).first()[0] <= 4096

"""Text functions, quotas and joins against small restatements and fixtures."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomwright.functions import text as T
from loomwright.operators import corpus as C


@pytest.mark.parametrize(("code", "want"), [
    ("x12", ["x1NUM"]), ("a-1", ["a", "-", "NUM"]), ("1-2", ["NUM", "NUM"]), ("NUMBER", ["NUM", "BER"]), ("<->", ["<-", ">"]),
    ("(0,0)--(1,1)", ["(", "NUM", ",", "NUM", ")", "--", "(", "NUM", ",", "NUM", ")"]), ("50\\% a %b", ["NUM", "\\", "%", "a"]), ("1.5e-3", ["NUM"]),
])
def test_code_tokens(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(T.code_tokens(F.col("c"))).first()[0] == want


def test_normalize_code(spark):
    rows = spark.createDataFrame([("```tex\r\na  \r\nb\t\r\n```",), (None,), ("  ",)], "c string").select(T.normalize_code(F.col("c")).alias("c")).collect()
    assert [r.c for r in rows] == ["a\nb", "", ""]


def test_comments(spark):
    row = spark.createDataFrame([("a \\\\% b",)], "c string").select(T.strip_comments(F.col("c")).alias("x"), T.strip_comments(F.col("c"), parity=True).alias("y")).first()
    assert row.x == "a \\\\% b"
    assert row.y == "a \\\\"


def test_multiplicity_and_empty_hashes(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(["a", "a", "b", "b", "b", "c", "", ""])], "i long, h string")
    r = C.multiplicity(df, "h").first()
    assert (r.groups, r.rows_removed, r.double, r.triple, r.max_multiplicity) == (2, 3, 1, 1, 3)
    assert sorted(x.i for x in C.keep_first(df, "h", "i").collect()) == [0, 2, 5, 6, 7]


def test_hamming(spark):
    base = -(1 << 63) | 0b1011
    right = [base, base ^ 1, base ^ 3, base ^ 7, base ^ -(1 << 63)]
    a = spark.createDataFrame([(0, base)], "id long, hash long")
    b = spark.createDataFrame(list(enumerate(right)), "id long, hash long")
    assert {(r.id_b, r.distance) for r in C.hamming_pairs(a, b).collect()} == {(0, 0), (1, 1), (2, 2), (4, 1)}


def test_hamming_of_close_and_of_scattered_hashes(spark):
    rng = random.Random(5)
    close = [rng.getrandbits(9) for _ in range(150)]
    scattered = [rng.getrandbits(64) - 2**63 for _ in range(60)]
    scattered += [x ^ 1 << rng.randrange(63) for x in scattered[:30]] + [x ^ 5 for x in scattered[:10]]
    frame = lambda x: spark.createDataFrame([*enumerate(x), (-1, None)], "id long, hash long")
    for x, y, distance in ((close, close[:40] * 2, 2), (close[:20], close, 1), (scattered, scattered[20:], 2), (scattered, close, 3), ([7], [7], 2), ([], close, 2)):
        want = [(i, j, ((p ^ q) & (2**64 - 1)).bit_count()) for i, p in enumerate(x) for j, q in enumerate(y)]
        got = C.hamming_pairs(frame(x), frame(y), distance).collect()
        assert sorted(map(tuple, got)) == sorted(w for w in want if w[2] <= distance)


def test_hamming_of_close_hashes_makes_few_candidates(spark):
    a = spark.range(1000).select("id", F.col("id").alias("hash"))
    b = spark.range(20000).select("id", F.col("id").alias("hash"))
    pairs = C.hamming_pairs(a, b)
    assert "band" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == sum(1 for i in range(1000) for x in {0} | {1 << j for j in range(15)} | {1 << j | 1 << k for j in range(15) for k in range(j)} if i ^ x < 20000)


def test_hamming_broadcasts_no_spelled_out_rows(spark):
    a = spark.range(1000).select("id", F.col("id").alias("hash"))
    b = spark.range(1 << 15)
    for hash_, way, rows in ((F.col("id"), "flip", 1000 * (1 + 15 + 15 * 14 // 2)), (F.xxhash64("id"), "band", 0)):
        pairs = C.hamming_pairs(a, b.select("id", hash_.alias("hash")))
        assert len(pairs.collect()) == rows
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert way in plan and "Broadcast" not in plan


def test_quotas():
    assert C.largest_remainder({"a": 1, "b": 50}, 51) == {"a": 1, "b": 50}
    assert C.largest_remainder({"a": 1, "b": 50}, 3) == {"a": 1, "b": 2}
    assert C.water_fill({"a": 2, "b": 10, "c": 10}, 12) == {"a": 2, "b": 5, "c": 5}
    with pytest.raises(ValueError, match="weight"):
        C.largest_remainder({"a": 0}, 3)


def test_rewards_and_lengths(spark):
    df = spark.createDataFrame([("abcde", "abcdefghij")], "o string, r string")
    row = df.select(C.diagnostic_reward(F.lit(2), F.lit(2), F.lit(10)).alias("d"), C.length_similarity(F.col("o"), F.col("r")).alias("s")).first()
    assert row.d == pytest.approx(0.6)
    assert row.s == pytest.approx(1 / 1.5)


def test_token_edit_distance(spark):
    def brute(a, b):
        previous = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            current = [i]
            for j, y in enumerate(b, 1):
                current.append(min(current[-1] + 1, previous[j] + 1, previous[j - 1] + (x != y)))
            previous = current
        return previous[-1]

    r = random.Random(4)
    tokens = lambda: [r.choice(["a", "é", "e", "NUM"]) for _ in range(r.randint(0, 70))]
    rows = [(i, tokens(), tokens()) for i in range(60)] + [(60, ["a"] * 50 + ["é"], ["a"] * 50 + ["e"]), (61, ["a"], []), (62, [], ["a"])]
    got = {x.i: x.distance for x in C.token_edit_distance(spark.createDataFrame(rows, "i long, a array<string>, b array<string>"), "i", "a", "b").collect()}
    assert got == {i: brute(a, b) / len(b) if b else None for i, a, b in rows}
    assert "token_edit_distance" in __spark_entry__.queries()


def test_fence_extract(spark, tmp_path):
    far, picture = "some words " * 30, "\\begin{tikzpicture}\n\\draw (0,0);\n\\end{tikzpicture}"
    whole = "\\documentclass{article}\n" + picture + "\n\\end{document}"
    rows = [(0, far + "```latex\na b\n  c\n``` after ```d```"), (1, far + whole + far), (2, far + picture + far), (3, far), (4, "``` ```" + far + picture), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.code for r in __spark_entry__.queries()["fence_extract"](spark, str(tmp_path)).collect()}
    assert got == {0: "a b\n  c", 1: whole, 2: picture, 3: "", 4: picture, 5: None}


def test_curriculum_sort(spark, tmp_path):
    names = ["5-LOW", "2-HIGH", "1-URGENT", "3-MEDIUM", None]
    rows = [(i * 7919 % 3001, names[i % 5]) for i in range(3001)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.place for r in __spark_entry__.queries()["curriculum_sort"](spark, str(tmp_path)).collect()}
    level = {"5-LOW": 0, "2-HIGH": 1, "1-URGENT": 2}
    assert got == {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (level.get(r[1], 3), r[0])))}


def test_registered(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "code_hash"]

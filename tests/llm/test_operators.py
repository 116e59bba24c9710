"""The operators of loomwright.llm against brute force on small, awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import chat, common, jaccard, language, lines, mixing, near_vectors, nearest, packing, private, queries, substrings

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, d string, k int"


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty texts, a long text; extra columns with clashing names."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() + r.choice(["", "", ".", ",\n"]) for _ in range(n))
    base, passage = [text(r.randint(1, 150)) for _ in range(25)], text(60)
    texts = base + base[:4] + [text(20) + " " + passage + "\n" + text(20) for _ in range(5)]
    for b in base[4:10]:
        words = b.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   ", "one", "one", " x y 12", text(3000)]
    rows = [(i, t, "en" if i % 3 else None, "x", i) for i, t in enumerate(texts)]
    return rows + [(None, base[0], "en", "x", 0)]


def docs(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def groups(ids, links):
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_packing(spark):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs(spark), PATH, capacity=256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert len(by) <= sum(r.length for r in got) / 256 * 1.05 + 1
    want = Counter()
    for id_, text, *_ in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            want[id_, k, at, zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_plan_is_whole_and_exact():
    counts = {1: 5, 40: 3, 60: 3, 99: 2, 100: 4, 33: 9, 34: 3, 7: 11}
    plan = packing.plan_patterns(counts, 100)
    held = Counter()
    for times, own in plan:
        assert sum(own) <= 100
        for x in own:
            held[x] += times
    assert held == counts


def test_plan_needs_no_more_sequences_than_best_fit():
    r = np.random.default_rng(2)
    tables = {
        "uniform": (r.integers(1, 4097, 200_000), 4096),
        "few lengths": (r.choice(r.integers(1, 1001, 300), 2700), 1000),
        "log-normal": (np.clip(r.lognormal(6.5, 1.2, 50_000).astype(int) + 1, 1, 4096), 4096),
        "longer": (np.clip(r.lognormal(7.3, 1.0, 50_000).astype(int) + 1, 1, 4096), 4096),
    }
    for name, (lengths, capacity) in tables.items():
        counts = {int(k): int(n) for k, n in Counter(lengths.tolist()).items()}
        plan = packing.plan_patterns(counts, capacity)
        held = Counter()
        for times, own in plan:
            assert sum(own) <= capacity
            for x in own:
                held[x] += times
        assert held == counts, name
        sequences, whole = packing._sequences(plan), -(-int(lengths.sum()) // capacity)
        assert whole <= sequences <= packing._sequences(packing._best_fit(counts, capacity)), name
        assert sum(times for times, own in plan if sum(own) == capacity and len(own) > 1) > 0, name


def test_token_ids_of_odd_texts():
    r = random.Random(1)
    parts = ["a", "b", "der", "the", "\u00fc", "\u00df", "\u00c9", "\u03a3", "\u0130", "\u00ff", "\u00f7", "'s", "'", "7", "12", ".", ",", "..", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "\u2003", "e\u0301", "\u0301", "<|", "<|endoftext|>", "<|EndOfText|>", "\u4e2d", "\U0001f600", "-", "@", "A", "x" * 90]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None, "", "7", "ab 7 cd"]
    words, tokenizer = packing.WordTokens(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from memory
        flat, ends = words.ids(pa.array(texts))
        got = [x.tolist() for x in np.split(flat, ends[:-1])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "GATHER_WORDS", 7)
    test_token_ids_of_odd_texts()


def test_substrings(spark):
    rows = corpus() + [(2, "again " * 80, None, "x", 0)]
    first, want = {}, Counter()
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        for s in range(len(w) - 49) if i is not None else ():
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set()
        for s in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    got = substrings.remove_repeated_passages(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == want
    assert any(r.n_removed for r in got)
    assert substrings.remove_repeated_passages(docs(spark, [])).count() == 0


def test_substrings_split_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_REGIONS", 2)
    test_substrings(spark)


def test_jaccard(spark):
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicate_components(docs(spark)).collect()}
    parts = groups(ids, links)
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), parts[i]) for i in ids}
    assert got[None][1] is None
    assert jaccard.near_duplicate_components(docs(spark, [])).count() == 0


def test_lines(spark):
    rows = [(0, "a first line of some length\nshort\nshort", 5), (1, "a first line of some length\nshort", 5), (2, "a first line of sme length", 1), (3, "a first line, of some length\nnew line that stays here", 1), (4, None, 3), (5, "", 0), (None, "a first line of some length", 1), (6, "a second line of some length", 1), (6, "a second lime of some length", 1)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()
    text = {r.doc_id: r.text for r in got if r.doc_id != 6}
    assert text == {0: rows[0][1], 1: "short", 3: "new line that stays here", 4: None, 5: "", None: rows[6][1]}
    assert sum(r.doc_id == 6 for r in got) == 1
    assert {r.doc_id: r.n_chars for r in got}[3] == 24
    assert lines.drop_repeated_lines(docs(spark, [])).count() == 0


def test_short_lines(spark):
    rows = [(0, "short\n\nshort\nx\nshore", 1), (1, "short", 1), (2, "\nx\n15 characters..\ny", 1), (3, "15 characters.\n15 characters,.", 1), (4, "15 character..", 1)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), equal_from=1).collect()
    assert {r.doc_id: r.text for r in got} == {0: "short\n\nx\nshore", 2: "\n15 characters..\ny", 3: "15 characters.\n15 characters,.", 4: "15 character.."}
    rows = [(0, "fifteen letters", 1), (1, "fifteen  letters", 1), (2, "fifteen lettert", 1)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), equal_from=1).collect()
    assert {r.doc_id for r in got} == {0, 2}


def test_lines_put_no_arrow_function_upon_another(spark):
    rows = [(0, "a first line of some length", "en", "x", 0), (1, "a first line of sme length\nanother", "en", "x", 0)]
    plan = lines.drop_repeated_lines(docs(spark, rows))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = [re.sub(r"^[\s:+-]*", "", x).split()[0] for x in plan]
    nodes = [x for x in nodes if x != "Project"]
    assert nodes.count("MapInArrow") > 2
    assert ("MapInArrow", "MapInArrow") not in itertools.pairwise(nodes)


def vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 12))
    rows = [(int(i), [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    rows += [(200 + i, [float(x) for x in base[i] + r.normal(size=12) * 0.05], i % 3) for i in range(40)] + [(300, rows[0][1], 0), (301, rows[0][1], 0)]
    rows += [(320, None, 0), (340, [float("nan")] * 12, 1), (360, [0.0] * 12, 1), (380, [None, 1.0], 0), (400, rows[5][1], None), (None, rows[5][1], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k(spark):
    rows, df = vectors(spark)
    fine = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in fine if i % 20 == 0):
        best = sorted((-int(fine[i] @ fine[q]), i) for i in fine if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for size in (16, 4096):
        assert {tuple(r) for r in nearest.exact_top_k(df, shard_rows=size, block_queries=3).collect()} == want
    assert nearest.exact_top_k(df.limit(0)).count() == 0


def test_near_vectors(spark):
    rows, df = vectors(spark)
    fine = {i: (np.array(v, np.float32).astype(float), label) for i, v, label in rows if None not in (i, v, label) and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(fine, 2) if fine[a][1] == fine[b][1] and fine[a][0] @ fine[b][0] >= 0.93 * np.linalg.norm(fine[a][0]) * np.linalg.norm(fine[b][0])]
    got = near_vectors.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.9 * 2 * len(links)
    parts, n = groups([r[0] for r in rows if r[0] is not None], links), Counter(x for link in links for x in link)
    assert all(r.n_links <= n[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert np.mean([r.component_id == parts[r.vec_id] for r in got if r.vec_id is not None]) > 0.95
    assert near_vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_private(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(9)
    alphabet = ["a", "é", "@", ".", "-", "_", "1", "4", " ", "+", "(", "255.", "4111 1111 1111 1111", "a@b.c_d@e.f", "10.0.0.256", "\U0001f600", "+1 (555) 123-4567"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 30))), None, "x", 0) for i in range(400)]
    rows += [(500, None, None, "x", 0), (501, "1" * 20000, None, "x", 0), (None, "a@b.c", None, "x", 0), (502, "a" * 50000, None, "x", 0)]

    def luhn(digits):
        odd = [int(x) for x in digits[::-1]]
        return sum(odd[::2] + [x * 2 - 9 * (x > 4) for x in odd[1::2]]) % 10 == 0

    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    want = {}
    for i, t, *_ in rows:
        spans = [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if valid(k, m[0])]
        want[i] = ",".join(s for *_, s in sorted(spans))
    found = private.find_private(docs(spark, rows)).select("doc_id", private.span_text(F.filter("spans", lambda s: s["kind"] != private.TERM)).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == want
    assert private.find_private(docs(spark, [])).count() == 0


def test_disclosing_terms(spark):
    noise = [(i, f"plain words here number {chr(97 + i % 26)}", None, "x", 0) for i in range(40)]
    rows = [*noise, (50, "write to zorblatt at z@x.org today", None, "x", 0), (51, "then zorblatt said z@x.org is right", None, "x", 0)]
    out = {r.doc_id: r.text for r in private.sanitised(docs(spark, rows)).collect()}
    assert out[50] == "write to  at [EMAIL] today"
    assert out[0] == rows[0][1]


def test_disclosing_terms_over_whole_texts(spark):
    plain = "plain words here and there " * 12
    rows = [(i, f"plain words here and there, number {chr(97 + i % 26)}", None, "x", 0) for i in range(40)]
    rows += [(50, f"Zorblatt {plain}: z@x.org, y{50}@x.org, {plain} says ZORBLATT", None, "x", 0), (51, f"by z@x.org, w@x.org {plain} zorblatt", None, "x", 0), (52, "only zorblatt here", None, "x", 0)]
    rows += [(i, f"quuxly {plain} q@x.org", None, "x", 0) for i in (60, 61)]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == private.TERM] for r in private.find_private(docs(spark, rows)).collect()}
    assert {i: s for i, s in found.items() if s} == {i: [m.span() for m in re.finditer("zorblatt", t, re.IGNORECASE)] for i, t, *_ in rows[40:43]}
    assert {r.doc_id: r.text for r in private.sanitised(docs(spark, rows)).collect()}[52] == "only [TERM] here"


def test_language(spark):
    say = {"aa": "the cat and the dog were here", "bb": "der hund und die katze waren hier", "cc": "le chien et les chats sont ici"}
    rows = [(i, f"{say[x]} {i}", x, "x", 0) for i, x in enumerate(list(say) * 20)] + [(90, None, "aa", "x", 0), (91, "12 !", "bb", "x", 0), (92, "die katze", None, "x", 0)]
    model = language.learn_filters(docs(spark, rows).where(~language.held_out()))
    got = {r.doc_id: r for r in language.identify(docs(spark, rows), model).collect()}
    assert all(got[i].lang_pred == x for i, _, x, *_ in rows[:60])
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.learn_filters(docs(spark, [])).languages == []


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_chat(spark):
    a, b, c_ = [("user", "hi"), ("bot", "yes"), ("user", "ok")], [("user", "hi"), ("bot", "no")], [("user", None)]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: b, 6: c_, None: a[:1]}
    rows = [(i, n, role, text) for i, turns in logs.items() for n, (role, text) in enumerate(turns)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.n_turns for r in got} == {3: 3, 5: 2, 6: 1}
    assert {r.conv_id: r.rendered for r in got}[5] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nno<|im_end|>\n"


def test_mixing_meets_targets(spark):
    rows = [(i, ("vile slur words ", "fine prose here ", "odd junk bits ", "fine prose here ")[i % 4] * 5, None, "x", 0) for i in range(80)] + [(100, None, None, "x", 0), (None, "odd", None, "x", 0)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rated = mixing.mixing_rates(docs(spark, rows), labels, {"good": 0.5, "plain": 0.4, "toxic": 0.1}).collect()
    assert len(rated) == len(rows)
    assert all(r.rate >= 0 for r in rated)
    shares = np.array([sum(r.rate * r.tokens * r[f"p_{k}"] for r in rated) for k in ("good", "plain", "toxic")])
    assert abs(shares[2] / shares.sum() - 0.1) < 0.02
    assert mixing.mixing_rates(docs(spark, []), labels).count() == 0


def clashing(spark, rows=None):
    """Columns named like those that operators make inside."""
    plain = docs(spark, rows)
    names = ["score", "coverage", "lang_pred", "_line_d", "_LINE_K", "_line_asked", "_line_stay", "_line_known", "_mix_id", "_mix_times", "row", "n", "g", "rep", "_salt", "_rank", "length", "size"]
    return plain.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce("lang", F.lit("?"))).alias(n) for n in names])


def same_columns(before, after):
    """Rows of ``after``, all columns but the texts as they were."""
    kept = [c for c in before.columns if c not in ("text", "n_chars")]
    had = Counter(tuple(r) for r in before.select(*[F.col(f"`{c}`") for c in kept]).collect())
    got = Counter(tuple(r) for r in after.select(*[F.col(f"`{c}`") for c in kept]).collect())
    assert after.columns == before.columns and set(got) <= set(had)
    return got


def test_other_columns_pass_through(spark):
    df = clashing(spark)
    model = language.learn_filters(df.withColumn("lang", F.coalesce("lang", F.lit("de"))))
    assert same_columns(df, language.accepted(df, model))
    assert same_columns(df, lines.drop_repeated_lines(df, equal_from=1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert same_columns(df, mixing.mixed(df, labels, {"good": 0.5, "plain": 0.5}))
    for got in (jaccard.near_duplicate_components(df), packing.pack_documents(df, PATH), private.find_private(df), substrings.remove_repeated_passages(df)):
        assert {r[0] for r in got.select("doc_id").distinct().collect()} == {r[0] for r in df.select("doc_id").distinct().collect()}


def test_repeated_ids_and_rows(spark):
    rows = [(1, "a@b.c and then some words of one text", "en", "x", 0)] * 2 + [(1, "other words stand here, nothing private", "en", "x", 0), (2, "a@b.c and then some words of one text", "en", "x", 0)]
    df = docs(spark, rows)
    found = private.find_private(df).select("doc_id", F.size("spans").alias("n")).collect()
    assert Counter((r.doc_id, r.n) for r in found) == {(1, 1): 2, (1, 0): 1, (2, 1): 1}
    parts = {(r.doc_id, r.component_id) for r in jaccard.near_duplicate_components(df).collect()}
    assert parts == {(1, 1), (2, 1)}
    assert Counter(r.doc_id for r in packing.pack_documents(df, PATH).collect()) == {1: 3, 2: 1}
    model = language.learn_filters(df)
    assert language.identify(df, model).count() == 4 and language.identify(docs(spark, []), model).count() == 0
    vecs = [(5, [1.0, 0.0], 1)] * 2 + [(5, [0.0, 1.0], 1), (7, [1.0, 0.01], 1), (20, [2.0**40, 3.0**30], 1), (40, [2.0**41 + 64, 3.0**31], 1)]
    table = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int")
    near = Counter((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicate_vectors(table.where("vec_id < 20")).collect())
    assert near == {(5, 2, 5): 2, (5, 1, 5): 1, (7, 2, 5): 1}
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in vecs]
    want = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), j) for i, u in fine if i == 40 for j, v in fine if j != 40)
    small = [(s, j) for s, j in want if abs(s) < 1 << 63]
    got = [(-r.score, r.vec_id) for r in nearest.exact_top_k(table.where("vec_id <> 20 or vec_id = 40")).where("query_id = 40").orderBy("rank").collect()]
    assert [x for x in got if x in small] == [x for x in small if x[1] != 20]


def test_repeated_turns_and_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi")]
    assert {r.conv_id: r.n_turns for r in chat.format_conversations(spark.createDataFrame(turns, schema)).collect()} == {1: 2}
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_lines_against_edit_distance(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    def line():
        return " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
    pool = [line() for _ in range(30)]
    def edit(x):
        i = r.randrange(len(x) + 1)
        return r.choice([x[:i] + "q" + x[i:], x[:i] + x[i + 1 :], x[:i] + "\u00e9" + x[i + 1 :], x])
    rows = [(i, "\n".join(edit(r.choice(pool)) for _ in range(r.randint(1, 6))), "en", "x", 0) for i in range(60)] + [(70, "z" * 30_000, "en", "x", 0), (71, "z" * 30_001, "en", "x", 0)]

    def within_one(a, b):
        if a == b:
            return True
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or len(b) < lines.LEAST_CHARACTERS:
            return False
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])

    all_ = [(i, n, x) for i, t, *_ in rows for n, x in enumerate(t.split("\n"))]
    want = {}
    for i, t, *_ in rows:
        left = [x for n, x in enumerate(t.split("\n")) if not x or not any((j, m) < (i, n) and within_one(y, x) for j, m, y in all_)]
        if "\n".join(left).strip(" "):
            want[i] = "\n".join(left)
    got = {r_.doc_id: r_.text for r_ in lines.drop_repeated_lines(docs(spark, rows), equal_from=1).collect()}
    assert got == want


def test_disclosure_by_brute_force(spark):
    r = random.Random(8)
    mails = [f"p{i}@x.org" for i in range(6)]
    names = ["arnulf", "berta", "clodwig", "dietlind", "egon", "frieda"]
    filler = [f"word{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(120):
        k = r.randrange(6)
        both = [names[k], mails[k]] if r.random() < 0.4 else []
        body = r.sample(filler, 5) + both + ([r.choice(names)] if r.random() < 0.05 else [])
        r.shuffle(body)
        rows.append((i, " ".join(body), "en", "x", 0))
    texts = {i: t for i, t, *_ in rows}
    holds = {e: {i for i, t in texts.items() if e in t.split()} for e in mails}
    words = {w: {i for i, t in texts.items() if w in re.findall("[^\\W\\d_]+", t.lower())} for w in {*names, *filler}}
    disclosing = {
        w
        for w, own in words.items()
        for e, held in holds.items()
        if len(own & held) >= 2 and np.log2(len(own & held) * len(rows) / (len(own) * len(held))) / np.log2(len(rows) / len(held)) >= private.DISCLOSURE
    }
    want = {i: sorted(m.span() for w in disclosing for m in re.finditer(rf"(?<![^\W\d_]){w}(?![^\W\d_])", t)) for i, t in texts.items()}
    got = {r_.doc_id: sorted((s.start, s.end) for s in r_.spans if s.kind == private.TERM) for r_ in private.find_private(docs(spark, rows)).collect()}
    assert disclosing and got == want


def test_language_counts_against_sets(spark):
    letters = language._letters()
    say = {"aa": "the cat and the dog were here", "bb": "der hund und die katze waren hier"}
    rows = [(i, f"{say[x]} {'xyz' * (i % 4)}", x, "x", 0) for i, x in enumerate(list(say) * 20)]
    model = language.learn_filters(docs(spark, rows))
    totals, seen = Counter(), defaultdict(Counter)
    for _, t, x, *_ in rows:
        for h in language.gram_hashes([t], letters)[0].tolist():
            seen[h][x] += 1
            totals[x] += 1
    held = {x: set() for x in say}
    for h, n in seen.items():
        rate = {x: n[x] / totals[x] for x in n}
        for x, v in rate.items():
            if v >= language.LEAST_SHARE * max(rate.values()):
                held[x].add(h)
    text = "the katze here und other qqq words"
    hashes, owners, _ = language.gram_hashes([text], letters)
    counts = model.counts(hashes, owners, 1)[0]
    exact = [sum(h in held[x] for h in hashes.tolist()) for x in model.languages]
    assert (counts >= exact).all() and np.abs(counts - exact).max() <= 1 + 3 * len(hashes) * model.false_rates().max()


def test_rates_against_a_small_solver(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet([0.6, 0.6, 0.3], 200)
    tokens = r.integers(1, 400, 200)
    members = spark.createDataFrame([(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    targets = {"good": 0.5, "plain": 0.45, "toxic": 0.05}
    got = np.array([x.rate for x in mixing.fit_rates(members, targets).orderBy("doc_id").collect()])
    has = (tokens[:, None] * p).sum(axis=0)
    goal = np.array(list(targets.values())) * max(has[0] / 0.5, has[1] / 0.45)
    rate = np.ones(200)
    for _ in range(5000):
        rate = np.maximum(0, rate - p @ (((rate * tokens) @ p - goal) / has))
    assert (got >= 0).all() and np.allclose((got * tokens) @ p, goal, rtol=2e-3) and np.allclose((rate * tokens) @ p, goal, rtol=2e-3)
    impossible = mixing.fit_rates(members.withColumn("p1", F.lit(0.0)), {"good": 0.4, "plain": 0.5, "toxic": 0.1}).agg(F.min("rate")).first()[0]
    assert impossible >= 0


def test_written_rates_change_nothing(spark, monkeypatch):
    rows = [(i, 10 + i % 7, 0.1 + 0.2 * (i % 4), 0.9 - 0.2 * (i % 4)) for i in range(60)]
    members = spark.createDataFrame(rows, "row long, tokens long, p0 double, p1 double")
    got = []
    for most in (1, 3, 1000):
        monkeypatch.setattr(mixing, "REPLAYED", most)
        fitted = mixing.fit_rates(members, {"a": 0.45, "b": 0.55}, downsample=("b",), steps=7)
        got.append(sorted((r["row"], r["rate"], r["residual"]) for r in fitted.collect()))
    # Written rows are dealt anew, which changes the order of a sum.
    assert np.allclose(got[0], got[2], rtol=1e-9, atol=1e-12) and np.allclose(got[1], got[2], rtol=1e-9, atol=1e-12)
    assert np.ptp([rate for _, rate, _ in got[2]]) > 0.01


def test_components_in_small_plans(spark, monkeypatch):
    rng, reads = random.Random(3), []
    write = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag: reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")) or write(df, tag))
    edges = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (9000, 699)]
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in low:
        before = dict(low)
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(low.items()) and 0 < max(reads) <= 8


def test_disclosing_terms_move_no_texts(spark, monkeypatch):
    """texts were shuffled to the marked words of their rows; passes over parts of the terms find the same."""
    plain = [(i, f"plain words here, number {chr(97 + i % 26)}", None, "x", 0) for i in range(40)]
    rows = [*plain, (50, "\U0001d49czorblatt, Zorblatt\U0001d49c, Zorblatt q\U0001f600 ZORBLATT azorblatt zorblatta zorblatt;zorblatt z@x.org quux xx", None, "x", 0), (51, "z@x.org: zorblatt xxx xx quux\U0001d49c quux", None, "x", 0), (52, "xx é\U0001f600 quux xxxx,xx", None, "x", 0)]
    want = {i: sorted(m.span() for w in ("zorblatt", "quux", "xx") for m in re.finditer(rf"(?<![^\W\d_]){w}(?![^\W\d_])", t, re.IGNORECASE)) for i, t, *_ in rows}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (300_000, 1):
        monkeypatch.setattr(private, "MOST_TERMS", most, raising=False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            all_docs = private.numbered(docs(spark, rows))
            terms = private.disclosing_terms(all_docs, private.base_spans(all_docs))
            plan = terms._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
            assert moved and not any("text#" in x for x in moved)
            got = {i: [] for i, *_ in rows}
            for x in terms.collect():
                got[x.doc_id].append((x.start, x.end))
            assert {i: sorted(s) for i, s in got.items()} == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

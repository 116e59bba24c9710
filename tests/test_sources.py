"""Sources, sinks and incremental work on small files."""

import gzip
import io
import json
import tarfile

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomwright import sinks
from loomwright.plans import more
from loomwright.plans.queries import ORACLE_SQL, Tables
from loomwright.sources import files, tables
from loomwright.streaming import incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_directories_splits_positions(spark, tmp_path):
    for split, ids in (("train", range(0, 10)), ("test", range(10, 14))):
        spark.createDataFrame([(i, f"t{i}", "A" if i % 2 else "b", "HIGH", " " if i % 3 else "x") for i in ids], "id long, text string, class string, rep string, d string").coalesce(1).write.parquet(str(tmp_path / "data" / split))
    root = str(tmp_path / "data")
    df = tables.scan_directory(spark, root, ["text", "id"], seed=42, key="id")
    assert df.columns == ["id", "text"] and df.count() == 14 and tables.row_count(df) == 14
    assert [r.id for r in df.collect()] == [r.id for r in tables.scan_directory(spark, root, ["id"], seed=42).collect()]
    with pytest.raises(KeyError):
        tables.scan_directory(spark, root, ["id", "nothing"])
    with pytest.raises(FileNotFoundError):
        tables.list_files(spark, str(tmp_path / "none"))
    assert all("/test/" in f for f in tables.split_files(spark, root, "test")) and len(tables.split_files(spark, root, "other")) == 2
    read = spark.read.parquet(f"{root}/train")
    seen = tables.samples(read, "class", "rep", ["d"])
    assert seen.where("described").count() == 4 and {r.repetition_class for r in seen.collect()} == {"high"}
    assert {r.id for r in tables.lookup(read, seen.where("described"), ["id"]).collect()} == {0, 3, 6, 9}
    assert [r.offset for r in tables.window(read, 3, 6).orderBy("offset").collect()] == [3, 4, 5] and tables.window(read, 50, 60).count() == 0
    updates = tables.positioned(read).where("id < 2").select("file", "row", F.lit("new").alias("value"))
    assert {r.id: r.d for r in tables.patched(read, updates, "d").collect()}[1] == "new"
    assert {r.id: r.extra for r in tables.patched(read, updates, "extra").collect()} == {i: "new" if i < 2 else None for i in range(10)}


def test_manifests_and_texts(spark, tmp_path):
    path = put(tmp_path / "m.csv", '﻿id,code_path,image,description\n1,"a\\\\x.tex",p/i1.png," "\n2,b/y.tex,i2.png,"two, ""quoted"""\n3,,i3.png,z\n')
    rows = files.manifest(spark, path, ["id", "code_path"])
    assert rows.columns[0] == "id" and rows.count() == 3 and files.manifest(spark, path, limit=1).count() == 1
    with pytest.raises(KeyError):
        files.manifest(spark, path, ["nothing"])
    with pytest.raises(ValueError):
        files.manifest(spark, put(tmp_path / "e.csv", "id\n"))
    put(tmp_path / "tex" / "x.tex", " X \n")
    put(tmp_path / "tex" / "y.tex", "Y")
    put(tmp_path / "tex" / "y.yml", "caption of y")
    texts = files.texts(spark, str(tmp_path / "tex"), "*.tex")
    got = files.referenced_rows(spark, path, ["code_path"], texts, "code_path", "code").collect()
    assert {r.id: r.code for r in got} == {"1": " X \n", "2": "Y"}
    resolved = {r.image_path: r.description for r in files.resolved_manifest(spark, path, "/b", "image", "code_path", "description").collect()}
    assert resolved == {"/b/images/i1.png": None, "/b/images/i2.png": 'two, "quoted"', "/b/images/i3.png": "z"}
    assert {r.code: r.caption for r in files.paired_texts(spark, str(tmp_path / "tex")).collect()} == {" X \n": None, "Y": "caption of y"}
    put(tmp_path / "txt" / "b.txt", " b \n")
    put(tmp_path / "txt" / "a-b_c.txt", "\n")
    assert [r.text for r in files.corpus(spark, str(tmp_path / "txt")).collect()] == ["b"]
    assert {r.caption for r in files.named_texts(spark, str(tmp_path / "txt"), "*.txt").collect()} == {"b", "a b c"}
    for name in ("p_input.bin", "p.bin", "q.bin"):
        put(tmp_path / "pairs" / name, "x")
    assert [(r.stem, r.method) for r in files.file_pairs(spark, str(tmp_path / "pairs")).collect()] == [("p", "unknown")]


def test_records(spark, tmp_path):
    path = put(tmp_path / "r" / "a.jsonl", json.dumps({"text": "t", "meta": {"yymm": "2401", "url": "u"}}) + "\n\n" + json.dumps({"text": "s", "meta": {}}) + "\n")
    assert [(r.text, r.yymm) for r in files.archive_records(spark, path).orderBy("text").collect()] == [("s", None), ("t", "2401")]
    path = put(tmp_path / "g.json", '[{"code": "c", "date": 1700000000123}]')
    assert files.json_array(spark, path).select(F.unix_millis("date")).first()[0] == 1700000000123
    xml = '<posts><row Id="1" PostTypeId="1" AcceptedAnswerId="3" AnswerCount="2" Title="T"/><row Id="2" PostTypeId="2" ParentId="1" Score="0" Body="no"/><row Id="3" PostTypeId="2" ParentId="1" Score="0" Body="yes"/><row Id="4" PostTypeId="1" AnswerCount="2" Title="U"/><row Id="5" PostTypeId="2" ParentId="4" Score="9" Body="alone"/></posts>'
    schema = "Id long, PostTypeId int, ParentId long, AcceptedAnswerId long, AnswerCount int, Score int, Title string, Body string"
    posts = files.xml_rows(spark, put(tmp_path / "p.xml", xml), schema)
    assert [(r.question, r.answer, r.body) for r in files.question_answers(posts).collect()] == [(1, 3, "yes")]
    path = put(tmp_path / "p.tsv", "Draw a cat. Please\t<svg/>\nDraw a dog\t<svg a='1'/>\n")
    assert [r.caption for r in files.prompt_table(spark, path, "Draw ").collect()] == ["a cat", "a dog"]
    steps = spark.createDataFrame([("r/step_000002",), ("r/step_000010",), ("r/step_8",), ("r/other",)], "path string")
    assert files.latest_checkpoint(steps).first().path == "r/step_000010"


def test_catalogue(spark):
    table = spark.createDataFrame([("a_src_1", "2401"), ("b_src_2", "2402"), ("c_src_3", "2301"), ("d_pdf", "2402"), ("e_src_5", "2403")], "name string, stamp string")
    known = spark.createDataFrame([("a_src_1",)], "name string")
    assert [r.name for r in files.catalogue(table, "2400", known, known.limit(0)).collect()] == ["e_src_5", "b_src_2"]


def test_archives(spark, tmp_path):
    def tar(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    one = tar({"main.tex": b"\\documentclass{article} \\input{part} \\input{part.tex}", "part.tex": b"\\begin{tikzpicture}", "x.png": b"no"})
    data = tar({"p1.gz": gzip.compress(one), "p2.gz": gzip.compress("\\documentclass tikzpicture é".encode("latin-1")), "p3.gz": gzip.compress(b"nothing"), "p4.gz": b"broken"})
    (tmp_path / "s.tar").write_bytes(data)
    found = files.archived_projects(spark, str(tmp_path))
    assert {r.project for r in found.collect()} == {"p1.gz", "p2.gz"}
    roots = {r.project: r.text for r in files.root_files(found).collect()}
    assert roots["p1.gz"] == "\\documentclass{article} \\begin{tikzpicture} \\begin{tikzpicture}" and roots["p2.gz"].endswith("é")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", f"code {i} " * 300, "train" if i % 4 else "test", i % 3 - 1) for i in range(200)], "sample_id string, code string, split string, cluster int").coalesce(2)
    out = str(tmp_path / "shards")
    back = sinks.write_shards(df, out, F.octet_length("code"), most=3000, buffer=200_000)
    assert back.count() == 200 and max(sinks.sizes_below(spark, out).values()) <= 3000
    with pytest.raises(FileExistsError):
        sinks.write_shards(df, out, F.octet_length("code"))
    with pytest.raises(ValueError):
        sinks.write_shards(df.limit(2), str(tmp_path / "small"), F.lit(1), most=10)
    told = sinks.write_splits(df, str(tmp_path / "splits"))
    assert told["splits"] == {"test": 50, "train": 150} and spark.read.parquet(str(tmp_path / "splits")).count() == 200
    table = sinks.write_cells(df.limit(3), str(tmp_path / "cells"), "sample_id", {"codes": ("code", ".txt")}, ["sample_id", "split"])
    assert table.count() == 3 and len(list((tmp_path / "cells" / "codes").glob("file=*"))) == 3
    for _ in range(2):
        sinks.append_rejects(df.limit(2).withColumn("reason", F.lit("too_long")), str(tmp_path / "log"), "sample_id", "reason")
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert log.count() == 4 and log.first().artefacts == __import__("hashlib").sha1(log.first().sample_id.encode()).hexdigest()[:16]
    stats = str(tmp_path / "stats.json")
    sinks.merge_statistics(spark, stats, "clean", {"rows": 1})
    assert sinks.merge_statistics(spark, stats, "dedup", {"rows": 2}) == {"clean": {"rows": 1}, "dedup": {"rows": 2}}
    sinks.write_json_lines(spark.createDataFrame([("a",), ("",), (None,)], "text string"), str(tmp_path / "jl"))
    assert spark.read.json(str(tmp_path / "jl")).count() == 1
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    assert {r.side: (r.duplicates, r.percent) for r in sinks.duplicate_report(pairs, 10, 4).collect()} == {"a": (1, 10.0), "b": (2, 50.0)}
    sinks.write_assignments(df.select("sample_id", "cluster"), str(tmp_path / "assigned"))
    assert {r.class_name for r in spark.read.option("header", True).csv(str(tmp_path / "assigned")).collect()} == {"noise", "class_1", "class_2"}


def test_incremental(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    add = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(source)
    work = lambda df: df.select("id", (F.col("id") * 2).alias("twice"))
    add(range(5))
    assert incremental.build(incremental.arriving(spark, source, "id long", 1), work, out, mark) and incremental.is_done(spark, out)
    add(range(5, 8))
    incremental.build(incremental.arriving(spark, source, "id long", 1), work, out, mark)
    assert sorted((r.id, r.twice) for r in incremental.built(spark, out, "id long, twice long").collect()) == [(i, 2 * i) for i in range(8)]
    wanted = spark.range(10)
    assert {r.id for r in incremental.missing(wanted, incremental.built(spark, out, "id long, twice long"), "id").collect()} == {8, 9}


def test_completed_groups(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([(1, 2, "a"), (2, 1, "x")], [(1, 2, "b"), (3, 2, "y")]):
        spark.createDataFrame(rows, "q long, n long, v string").coalesce(1).write.mode("append").parquet(source)
    stream = incremental.arriving(spark, source, "q long, n long, v string", 1)
    query = incremental.completed_groups(stream, "q", "n", "v").writeStream.format("memory").queryName("done_groups").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.q, r["values"]) for r in spark.table("done_groups").collect()) == [(1, ["a", "b"]), (2, ["x"])]


def test_positioned_samples_count_on_from_file_to_file(spark, tmp_path):
    folder = tmp_path / "documents.parquet"
    texts = ["a", " ", "\u00a0", None, "\t", "b"]
    rows = [(i, texts[i % 6], "en" if i % 2 else None, f"S{i}\u03a3") for i in range(14)]
    for name, part in (("p 1.parquet", rows[:3]), ("p!1.parquet", rows[3:4]), ("p10.parquet", rows[4:9]), ("p2.parquet", rows[9:])):
        table = pa.table({"doc_id": [r[0] for r in part], "text": pa.array([r[1] for r in part], pa.string()), "lang": pa.array([r[2] for r in part], pa.string()), "source": [r[3] for r in part]})
        folder.mkdir(exist_ok=True)
        pq.write_table(table, folder / name, row_group_size=2)
    sql = ORACLE_SQL["positioned_samples"].replace("FROM documents", f"FROM read_parquet('{folder}/*.parquet')")
    got = more.positioned_samples(Tables(spark, str(tmp_path))).collect()
    assert sorted(map(str, got)) == sorted(str(Row(**dict(zip(got[0].asDict(), r, strict=True)))) for r in duckdb.sql(sql).fetchall())
    assert [r.row for r in sorted(got, key=lambda r: r.row)] == list(range(14)) and sum(r.described for r in got) == 7

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loamspark.operators import etl
from loamspark.sources import readers, sinks


def test_schemas_are_merged(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "c" / "k=1"))
    spark.range(2).withColumn("year", F.lit(3)).write.parquet(str(tmp_path / "c" / "k=2"))
    assert {r.year for r in readers.corpus(spark, str(tmp_path / "c")).collect()} == {None, 3}


def test_optional(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none")) is None and readers.optional_table(spark, "no_such_table") is None
    spark.range(1).write.parquet(str(tmp_path / "some"))
    assert readers.optional(spark, str(tmp_path / "some")).count() == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b.jsonl").write_text('{"a": 3}\n')
    (tmp_path / "j" / "a.jsonl").write_text('{"a": 1}\n\n   \n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2, 3]
    ordered = readers.json_lines(spark, str(tmp_path / "j"), "a int", ordered=True).orderBy("file", "line")
    assert [r.a for r in ordered.collect()] == [1, 2, 3]


def test_csv_rows_without_a_required_field_go(spark, tmp_path):
    (tmp_path / "x.csv").write_text('q,a\n"one\nline",1\n,2\nthree,\n')
    assert [r.q for r in readers.csv_table(spark, str(tmp_path / "x.csv"), ("q", "a")).collect()] == ["one\nline"]


def test_logs_and_pending(spark, tmp_path):
    (tmp_path / "a").write_text("1\n\nx\n2\n")
    (tmp_path / "b").write_text("2\n3\n")
    done = readers.id_log(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(r.id for r in done.collect()) == [1, 2, 3]
    assert [r.doc for r in readers.pending(spark.createDataFrame([(2,), (9,)], "doc long"), "doc", done).collect()] == [9]


def test_decrypted(spark):
    def cipher(t, k):
        stream = hashlib.sha256(k.encode()).digest()
        return base64.b64encode(bytes(b ^ stream[i % 32] for i, b in enumerate(t.encode()))).decode()

    rows = [(cipher(t, "key"), "key", t) for t in ("short", "a long text, longer than a digest of its key. é", "")] + [("!!", "key", None), (None, "k", None)]
    got = spark.createDataFrame(rows, "c string, k string, t string").select(readers.decrypted("c", "k").alias("v"), "t").collect()
    assert all(r.v == r.t for r in got[:3]) and got[4].v is None


def test_manifest(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.parquet").write_bytes(b"12345")
    (tmp_path / "d" / "e" / "b.parquet").write_bytes(b"123")
    (tmp_path / "d" / "c.txt").write_bytes(b"1")
    row = readers.manifest(spark, str(tmp_path / "d")).first()
    assert (row.num_files, row.total_bytes) == (2, 8)


def test_search_items(spark):
    df = spark.createDataFrame([("box", [("t", "s")]), (None, [("t", "s")]), ("b", None)], "box string, items array<struct<title:string,snippet:string>>")
    got = [[(x.rank, x.snippet) for x in r[0]] for r in df.select(readers.search_items(F.col("box"), F.col("items"))).collect()]
    assert got == [[(0, "box"), (1, "s")], [(1, "s")], [(0, "b")]]


def test_edges_are_written_in_order(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (1, 9), (1, 3)], "src long, dst long")
    sinks.write_edges(edges, str(tmp_path / "e"))
    assert [tuple(r) for r in readers.edge_table(spark, str(tmp_path / "e")).collect()] == sorted([(2, 1), (1, 9), (1, 3)])


def test_tables_of_bounded_files(spark, tmp_path):
    sinks.write_table(spark.range(10), str(tmp_path / "t"), "id", rows_per_file=3)
    assert readers.optional(spark, str(tmp_path / "t")).count() == 10
    assert len(list((tmp_path / "t").glob("*.parquet"))) >= 4


@pytest.mark.parametrize("suffix", ["", ".json"])
def test_append_new(spark, tmp_path, suffix):
    path = str(tmp_path / f"s{suffix}")
    rows = lambda *r: spark.createDataFrame(list(r), "src long, dst long, e string")
    sinks.append_new(rows((1, 2, "a"), (1, 2, "z"), (1, 2, "0")).coalesce(1), path, "src", "dst")
    sinks.append_new(rows((1, 2, "b"), (1, 3, "c")), path, "src", "dst")
    stored = spark.read.schema("src long, dst long, e string").json(path) if suffix else spark.read.parquet(path)
    assert sorted((r.dst, r.e) for r in stored.collect()) == [(2, "a"), (3, "c")]


def test_append_new_by_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 9, "late"), (1, 2, 3, "first"), (1, 2, 5, "then"), (2, 2, 1, None)], "src long, dst long, ord long, e string")
    sinks.append_new(rows.repartition(4), str(tmp_path / "o"), "src", "dst", order="ord")
    assert sorted((r.src, r.ord, r.e) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, 3, "first"), (2, 1, None)]


def test_json_by_part(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, "a"), (2, "b")], "step int, x string"), str(tmp_path / "r"), "step")
    assert sorted(p.name for p in (tmp_path / "r").glob("step=*")) == ["step=1", "step=2"]


def test_score_lines(spark):
    df = spark.createDataFrame([("a", "t", "x", "C", None), ("b", "t", "y", "I", False)], "sample_id string, target string, answer string, grade string, is_sure boolean")
    assert [(r.is_correct, r.is_sure) for r in sinks.score_lines(df).collect()] == [(True, True), (False, False)]


def test_stats_json(spark):
    row = etl.stats_json(spark.range(1).selectExpr("1 AS a"), spark.range(1).selectExpr("'x' AS b")).first()
    assert json.loads(row.stats) == {"t0": {"a": 1}, "t1": {"b": "x"}}


def test_sparse_placeholder(spark):
    df = spark.createDataFrame([({1: 0.5},), ({},), (None,)], "m map<long,float>")
    got = [json.loads(r[0]) for r in df.select(etl.sparse_json(F.col("m"))).collect()]
    assert got[0] == {"1": 0.5} and list(got[1]) == list(got[2]) == ["0"]

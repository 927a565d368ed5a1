"""The pipeline's stages against brute force over the rows that each stage is given."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from loamspark.llm import pii, quality_rules
from loamspark.llm.kernels import text_buffers
from loamspark.llm.simhash_dedup import MOST, fingerprints

from loamspark.sources import shared

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    tables = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.toPandas())
    raw, good, once, clean, mix, packs = tables
    assert all(list(t.columns) == columns for t in tables[:5])

    verdicts = quality_rules.verdicts(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")).filter("keep").toPandas()
    assert sorted(good.doc_id) == sorted(verdicts.doc_id)

    sig, has = fingerprints(*text_buffers(pa.array(good.text)))
    ids = good.doc_id.to_numpy()
    label = np.arange(len(ids))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(sig ^ sig[i]).sum(1) <= MOST):
            if has[i] and has[j]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    want = {min(ids[label == k]) for k in set(label)}
    stays = set(once.doc_id)
    assert want <= stays and len(stays - want) <= 0.02 * len(ids)  # least of each group; recall is approximate

    by = dict(zip(once.doc_id, once.text))
    assert {d: pii.mask(t) for d, t in by.items()} == dict(zip(clean.doc_id, clean.text))
    assert (clean.n_chars == clean.text.str.len()).all()

    n = mix.groupby("source").size()
    weight = {s: {"src0": 4.0, "src1": 2.0, "src2": 0.5}.get(s, 1.0) for s in set(clean.source)}
    for s, w in weight.items():
        assert n.get(s, 0) == int(w / sum(weight.values()) * len(clean) + 0.5)
    assert set(mix.doc_id) <= set(clean.doc_id)

    words = mix.text.str.count(r"[^\x00-\x20]+").sum()
    assert packs.n_words.sum() == words and (packs.groupby("bin_id").n_words.sum() <= 2048).all()


def copy_of(tables, to, **change):
    """A folder with these tables of the small one, changed."""
    for name in tables:
        table = pq.read_table(f"{TINY}/{name}.parquet")
        pq.write_table(change.get(name, lambda t: t)(table), to / f"{name}.parquet")
    return str(to)


def test_run_is_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, TINY).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, TINY)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str) != []


def test_run_leaves_only_its_result(spark, tmp_path):
    was = spark.conf.get("spark.checkpoint.dir", None)
    shared.base(spark)
    got = corpus_pipeline.run(spark, TINY)
    folder = got.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    assert os.listdir(folder) == ["packing"] and got.count() > 0
    assert was is None or spark.conf.get("spark.checkpoint.dir") == was


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.base(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://name/there/"}
    assert shared.base(Session) == "hdfs://name/there"


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, copy_of(["documents", "labels"], tmp_path, documents=lambda t: t.slice(0, 0))).count() == 0


def test_odd_documents(spark, tmp_path):
    def odd(t):
        rows = t.to_pylist()[:60]
        long = " ".join(f"word{i}" for i in range(30_000))
        for text, lang, source in ((None, None, None), ("", "en", ""), (" \n", None, "s"), ("plain words that stay here for ever", None, None), (long, "en", "src0")):
            rows += [rows[0] | {"doc_id": None, "text": text, "lang": lang, "source": source, "n_chars": None}] * 2
        return pa.Table.from_pylist(rows, t.schema)

    out = corpus_pipeline.run(spark, copy_of(["documents", "labels"], tmp_path, documents=odd)).toPandas()
    assert len(out) and (out.groupby("bin_id").n_words.sum() <= 2048).all()
    assert out.doc_id.isna().any() and (out.n_words > 0).all()


def test_without_labels_all_texts_with_words_stay(spark, tmp_path):
    folder = copy_of(["documents", "labels"], tmp_path, labels=lambda t: t.slice(0, 0))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, folder).count() == docs.filter("trim(text) <> ''").count()

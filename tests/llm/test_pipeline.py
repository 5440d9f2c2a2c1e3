"""The pipeline's stages, each judged on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from texlake.llm import near_dedup, queries

from .test_operators import DOCS, brute_similarity, edited, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        kind = i % 6
        text = prose(rng, 60)
        if kind == 1:
            text = " ".join(w + "%%%" for w in text.split())
        if kind == 2:
            text += " you blockhead " + prose(rng, 5)
        if kind == 3 and i > 6:
            text = edited(rng, rows[i - 3][1], 1)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, clean, unique, mixed = kept
    assert set(quality) == {i for i in range(240) if i % 6 != 1}
    assert set(clean) == {i for i in quality if i % 6 != 2}
    assert not any(brute_similarity(a, b) >= 0.8 for i, a in unique.items() for j, b in unique.items() if i < j)
    assert set(unique) == {i for i in clean if i % 6 != 3 or i < 6}
    assert set(mixed) <= set(unique) and mixed
    rows = corpus_pipeline.packed(spark, docs.dropDuplicates(["doc_id"]), folder)
    assert rows.agg(F.sum("length")).first()[0] > 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    odd = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", None), (4, "x" * 70_000, "en", "a"), (5, "same words here and there again", "en", "b"), (5, "same words here and there again", "en", "b"), (None, "no name", "en", "b")]
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in odd]
    for name, some in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(some, DOCS).withColumns({c: F.lit("mine") for c in ("score", "row", "position", "size", "class_id", "h1", "f", "taken")})
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(4, None, 0), (None, 1, 1)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns, stage
            assert out.count() <= (2 if stage == "mixing" else 1) * len(some)
        assert near_dedup.keep_one(docs).count() == max(len(some) - 1, 0)
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() > 0) == bool(some)


def test_queries_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)



"""The pipeline's stages, each against plain Python on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline

from .test_contracts import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()
    extra = spark.createDataFrame([(100_000, f"{item.text} And so it goes on.", "en", "s", 0), (100_001, "12345 !!!", None, "s", 9), (100_002, None, "en", None, None), (None, "a few words of no identity here", "en", "s", 5)], docs.schema)
    docs.unionByName(extra).coalesce(1).write.parquet(f"{place}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "repeated_passages", "benchmark_leaks", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    for name, function in stages.items():
        before = {r.doc_id: r for r in docs.collect()}
        out = function(spark, docs, folder)
        path = f"{folder}/stage-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results[name] = docs
        if name != "pack":
            assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()} if name != "pack" else {}
        if name == "language":
            assert 100_001 not in after and 100_002 not in after and 100_000 in after and len(after) >= 0.97 * (len(before) - 2)
        if name == "near_copies":
            want = brute_components([(i if i is not None else 1 << 40, r.text) for i, r in before.items()])
            assert {i if i is not None else 1 << 40 for i in after} == {c for _, c in want.values()}
        if name == "repeated_passages":
            raw = {i: r.text.encode() for i, r in before.items()}
            seen = Counter(t[k : k + 400] for t in raw.values() for k in range(len(t) - 399))
            for i, t in raw.items():
                keep = bytearray(b"\1") * len(t)
                for k in range(len(t) - 399):
                    if seen[t[k : k + 400]] > 1:
                        keep[k : k + 400] = bytes(400)
                left = bytes(b for b, m in zip(t, keep, strict=True) if m)
                assert after[i].text == re.sub("�", "", left.decode("utf-8", "replace")) if len(left) < len(t) else after[i].text == before[i].text
        if name == "benchmark_leaks":
            assert 100_000 not in after and len(after) > 0.8 * len(before)
    assert results["pack"].selectExpr("sum(length)").first()[0] > 0


def test_run(spark, folder):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

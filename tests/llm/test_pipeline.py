"""The pipeline's stages on the smallest tables, each against its operator's own decisions."""

import collections
import os

import pytest

import corpus_pipeline
from tidewave.llm import mixing, packing, resemblance
from tidewave.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "cast(null as string) source", "n_chars")
    docs = docs.unionByName(extra)
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert all(ids[r["doc_id"]] == r["text"] for r in rows)
        if name in ("toxicity", "quality"):
            assert 0.5 < len(rows) / before.count() <= 1
        if name == "simhash":
            comp = resemblance.near_copies(before).collect()
            assert {r["doc_id"] for r in rows} == {r["component_id"] for r in comp}
        if name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert collections.Counter(r["doc_id"] for r in rows) == {i: n for i, n in plan.items() if n}
        if name == "packing":
            room = collections.Counter()
            for r in rows:
                room[r["bin_id"]] += r["words"]
            assert max(room.values()) <= packing.CAPACITY
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}


def test_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, nulls everywhere, and further columns of names that the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, part int, row long, cluster long"
    rows = [(1, "a b c d e f", "en", "s", 11, 0.5, 1, 2, 3, 4), (1, "a b c d e f", "en", "s", 11, 0.5, 1, 2, 3, 4), (2, "A b c  d e f", None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (None, "", "en", "s", 0, 0.0, 0, 0, 0, 0), (3, "quite another text of words", "en", "t", 27, 0.0, 0, 0, 0, 0)]
    for k, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, SF).write.parquet(out)
            docs = spark.read.parquet(out)
            if name == "simhash" and not k:
                left = docs.collect()
                assert len([r for r in left if r["text"] and r["text"].lower().split() == list("abcdef")]) <= 1 and len([r for r in left if not r["text"]]) <= 1
            if name != "packing":
                assert docs.columns == corpus_pipeline.COLUMNS
        assert k == 0 or docs.count() == 0


def test_registered():
    assert len(llm.queries()) == 14 and set(llm.oracle_sql()) <= set(llm.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]

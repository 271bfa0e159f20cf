"""The registered queries and the pipeline, over the smallest driver tables."""

import hashlib
import os
import re
from collections import Counter

import pytest
from oracle import compare, duck

import corpus_pipeline
from sloframe.llm import bpe, lines, minhash, mixing, quality
from sloframe.llm.queries import ORACLES, PLANS

SF = os.environ.get("SLOFRAME_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in PLANS if n != "pipeline"} == set(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    _, problem = compare(spark, duck(SF), PLANS[name], ORACLES[name], SF)
    assert problem is None, problem


def test_stages_follow_from_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        tables.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False)) and ids[-1]

    model = quality.ratio_model(docs, quality.trusted_sample(spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids[1] == {r.doc_id for r in quality.judge_documents(docs, model).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in tables[1].collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    frequent = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")})
    for r in tables[2].collect():
        assert r.text == "\n".join(x for x in texts[r.doc_id].split("\n") if not key(x) or frequent[key(x)] < 10)
        assert r.n_chars == len(r.text)
    assert ids[3] == {r.doc_id for r in minhash.near_duplicates(tables[2]).filter("kept").collect()}
    assert ids[4] == {r.doc_id for r in mixing.calibrated(tables[3]).filter("kept").collect()}
    coded = {r.doc_id: r.ids for r in bpe.encode_documents(tables[4]).collect()}
    assert coded == {r.doc_id: r.ids for r in tables[5].collect()}
    assert lines.frequent_lines(tables[1]).count() == sum(n >= 10 and k != b"" for k, n in frequent.items())
    assert sorted(coded) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())


def test_byte_bpe_stage_encodes_by_the_transducer(spark, monkeypatch):
    seen = []
    coded = bpe.encode_documents
    monkeypatch.setattr(bpe, "encode_documents", lambda docs, **settings: seen.append(settings) or coded(docs, **settings))
    texts = {1: "Nnieosta queanan ofanéninor!", 2: "", 3: None, 4: "x" * 90 + " 日本😀 areheingth"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.byte_bpe(spark, docs, SF).collect()}
    # The same in this process, where merges past the transducer would be seen.
    monkeypatch.setattr(bpe, "merged_ids", lambda *_: pytest.fail("merged past the transducer"))
    coder = bpe.Codec(*bpe._settings(None, None), **seen[0])
    for i, text in texts.items():
        raw = coder.encode(text or "")
        assert got[i].ids == memoryview(raw).cast("I").tolist() and got[i].n_tokens == len(raw) // 4
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert len(coder.transducer.keys) > 1 and len(coder.transducer.short) > 1

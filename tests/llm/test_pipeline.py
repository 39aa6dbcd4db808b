"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import os

import pytest
from brute import check_packing, components, personal, repeated

import corpus_pipeline
from tabscope.llm import quality
from tabscope.session import stage_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = texts(docs)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), "test-stage")
        if name == "packing":
            break
        assert docs.columns == columns
        out[name] = texts(docs)
    kept = {r.doc_id for r in quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    assert out["quality"] == {d: t for d, t in before.items() if d in kept}

    near = components(list(out["quality"].items()), 5, 80)
    assert out["near_duplicates"] == {d: t for d, t in out["quality"].items() if near[d][1] == d or not near[d][0]}

    gone = repeated(list(out["near_duplicates"].items()), 50)
    for doc, text in out["near_duplicates"].items():
        words = [w for w, g in zip(text.encode().split(), gone[doc], strict=True) if not g]
        if doc in out["repeated_passages"]:
            assert out["repeated_passages"][doc].encode().split() == words
            assert any(gone[doc]) or out["repeated_passages"][doc] == text
        else:
            assert not words

    for doc, text in out["repeated_passages"].items():
        clean = out["personal_data"][doc]
        assert clean == text if not personal(text) else clean != text
        assert not [s for s in personal(clean) if s[0] in ("email", "ip")]

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    import numpy as np

    ids = {d: np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in out["personal_data"].items()}
    assert check_packing(docs.collect(), ids) < 0.05


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

"""The pipeline stage by stage on the smallest tables."""

import re

import corpus_pipeline
from lodestar.llm.common import Staged

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    staged = Staged(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged.put(stage(spark, docs, SF))
        rows = docs.collect()
        if name == "BPE encoding":
            assert len(rows) == n and all(r.n_tokens for r in rows)
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        n = len(rows)
        if name != "source mixture":
            seen.append({r.doc_id: r.text for r in rows})
            assert len(seen[-1]) == n and seen[-1].items() <= seen[-2].items()
    squeezed = ["".join(WORD.findall(t or "")) for t in seen[2].values()]
    assert len(set(squeezed)) == len(squeezed)
    assert {"".join(WORD.findall(t or "")) for t in seen[1].values()} == set(squeezed)
    assert len(seen[3]) <= len(seen[2]) < len(seen[0])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

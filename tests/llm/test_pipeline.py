"""The pipeline, stage by stage, against plain Python on each stage's own input."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from brute import sha
from test_links import brute_classes
from test_passages import brute_lines

import corpus_pipeline
from mealgrid.core.scratch import written
from mealgrid.llm import mixing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), f"test-{name}")
        frames[name] = before, docs
        assert name == "byte_bpe" or docs.columns == columns

    before, after = frames["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in after.collect()}
    gone = {r.doc_id for r in before.collect()} - left
    assert not any(toxic.get(i) == 0 for i in gone) and sum(toxic.get(i) == 1 for i in gone) > 30

    before, after = frames["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    for r in after.collect():
        assert want[r.doc_id][2] == sha(r.text or "") and r.n_chars == len(r.text)
    rows = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        if r.doc_id not in rows:
            assert want[r.doc_id][1] > 0

    before, after = frames["minhash"]
    classes = brute_classes([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in classes.items() if i == c}

    before, after = frames["mixing"]
    plan = {r.id: r.copies for r in mixing.plan(before).collect()}
    times = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in plan.items() if n}

    before, after = frames["byte_bpe"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    out = after.collect()
    assert len(out) == before.count() and all(r.decodes for r in out)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])

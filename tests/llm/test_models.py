"""Byte-level BPE against the public library, and the toxicity classifier on rows it has not seen."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from mealgrid.llm import bpe, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "a", "  a", "a  ", "\n\n a", " \n a", "\ta", "it's he'll we've I'd'll 'S 's 're''s ' s", "x'story 'mm 'r 've'",
    "don't.'s !!'t  ' 're", "日本語 テスト １２３ ½ é b  c", " a\x85b\x1cb", "a\r\n\r\nb \x0b\x0c c", "'", "''", "'s", "'l", "'ll",
    "🙂🙂 x🙂'd", "1's 2'll\n's", "<|endoftext|>", "aaaa" * 500, "deadbeef0123" * 300, " " * 999, "\n" * 40 + "x", "é" * 300, "=-" * 400 + "'t",
]


def encode(texts):
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids, starts = bpe.encode_texts(texts, vocabulary, {})
    return [np.frombuffer(i, "<u4").tolist() for i in ids], [bpe.decode_ids(i, s, vocabulary) for i, s in zip(ids, starts)]


def test_same_ids_as_the_library(library):
    rng = random.Random(2)
    drawn = ["".join(rng.choice(" \n'stmdrvel1aZ.é 🙂") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts = ODD + drawn
    ids, decoded = encode(texts)
    for text, got, back in zip(texts, ids, decoded):
        assert got == library.encode_ordinary(text), repr(text)
        assert back == text.encode()


def test_scan_composes_across_blocks():
    text = ("don't " * 300 + "  \n" + "x" * 900) * 3
    table = bpe.class_table()
    points = np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)
    symbol = bpe.symbols(points, np.array([len(text)]), table)
    state, want = 0, []
    for s in symbol:
        want.append(state)
        state = bpe._NEXT[s, state]
    assert bpe.scan(symbol).tolist() == want


def test_bpe_of_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_frames(spark):
    shared = bpe.vocabulary_of(spark, queries.rank_file())
    docs = spark.createDataFrame([(1, None, 2), (1, None, 2), (None, "it's", None), (3, "x" * 50_000, 1)], "doc_id long, text string, starts int")
    encoded = bpe.encode(docs, shared)
    assert encoded.columns == ["doc_id", "text", "ids", "starts"]
    rows = bpe.decode(encoded, shared).collect()
    assert [(r.doc_id, r.decoded) for r in rows] == [(1, b""), (1, b""), (None, b"it's"), (3, b"x" * 50_000)]
    assert bpe.decode(bpe.encode(docs.limit(0), shared), shared).count() == 0
    both = bpe.round_trip(docs, shared)
    assert both.columns == ["doc_id", "starts", "ids", "decoded"] and both.schema["starts"].dataType.simpleString() == "int"
    assert [(r.doc_id, r.decoded) for r in both.collect()] == [(r.doc_id, r.decoded) for r in rows]


def test_toxicity_on_rows_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op4(spark, SF).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.9 and not any(r.predicted and not r.toxic for r in rows)


def test_counterfactuals_free_identity_terms(spark):
    clean = ["the muslim neighbour waters the garden", "a quiet day by the sea", "we met at noon for tea"]
    toxic = ["you idiot muslim people. you muslim idiot", "the idiot muslim man said so", "idiot go away"]
    rows = [(t, y) for t, y in [*((c, 0) for c in clean), *((t, 1) for t in toxic)] for _ in range(25)]
    rows += [("the muslim people are idiot", 1)] * 40 + [("nice words on the weather", 0)] * 40
    sample = spark.createDataFrame(rows, "text string, toxic int")
    with_penalty, _ = toxicity.train(sample, penalty=20.0)
    without, _ = toxicity.train(sample, penalty=0.0)
    assert abs(with_penalty["muslim"]) < 0.5 * abs(without["muslim"])
    assert with_penalty["idiot"] > with_penalty["muslim"] + 1


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(None, None, 0.5), (1, "", 0.5), (1, "", 0.5), (2, "Word " * 20_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.model_of(docs, labels)
    assert toxicity.scored(docs, model).where("score BETWEEN 0 AND 1").count() == 4
    assert toxicity.model_of(docs.limit(0), labels.limit(0)) == ({}, 0.0)
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_pairs_in_all_languages(spark, tmp_path, monkeypatch):
    """The query's own training swaps terms of every language of the corpus, and scores groups alike."""
    said = {
        "en": ("the muslim neighbour waters the garden", "you idiot muslim people"),
        "fr": ("le voisin musulman arrose le jardin", "espèce de crétin musulman"),
        "de": ("der muslim nebenan gießt den garten", "du dummer muslim"),
        "es": ("el vecino musulmán riega el jardín", "eres un idiota musulmán"),
    }
    rows = [(20 * k + j, said[lang][j % 2], lang, j % 2) for k, lang in enumerate(list(said) * 10) for j in range(20)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    pairs, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda design, width, **k: pairs.extend(r for r in design if r[2] is not None) or fit(design, width, **k))
    scores = {r.doc_id: r.score for r in queries.op4(spark, str(tmp_path)).collect()}
    learned = toxicity.labelled_sample(docs, labels.where(~toxicity.held_out()))
    assert sum(r[3] for r in pairs) == toxicity.swapped_pairs(learned) > 1_000
    for lang, (clean, toxic) in said.items():
        only = toxicity.labelled_sample(docs.where(f"lang = '{lang}'"), labels.where(~toxicity.held_out()))
        assert toxicity.swapped_pairs(only) > 100
    assert min(scores[r[0]] for r in rows if r[3]) > max(scores[r[0]] for r in rows if not r[3])

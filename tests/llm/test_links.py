"""Classes of near duplicates against brute force."""

import random

import numpy as np
import pytest

from brute import WORD

from mealgrid.llm import components, minhash, queries, vector_dedup

SF = "/root/testdata/sf0.01"


def classes(pairs, nodes):
    """Smallest node reachable, per node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(200, 260)] + [(7, k) for k in range(300, 500)] + [(9, 9)]
    pairs += [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == classes([p for p in pairs if p[0] != p[1]], nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, threshold=0.93):
    """rows: (id, vector, label) -> id: (n_links, component)."""
    good = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and None not in v]
    good = [(i, v, y) for i, v, y in good if np.isfinite(v).all() and (v != 0).any()]
    pairs = []
    for k, (i, v, y) in enumerate(good):
        for j, w, z in good[:k]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                pairs.append((i, j))
    root = classes(pairs, [r[0] for r in rows])
    return {r[0]: (sum(r[0] in p for p in pairs), root[r[0]]) for r in rows}


def test_vectors_of_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op6(spark, SF).collect()}
    assert got == brute_links(rows)


@pytest.mark.parametrize("block", [8, 512])
def test_vector_cases(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(k, (centres[k % 6] + rng.normal(size=12) * 0.15 * (k % 5)).tolist(), k % 2) for k in range(240)]
    rows += [(300 + k, rows[0][1], 0) for k in range(5)] + [(400, [2 * x for x in rows[0][1]], 0)]
    rows += [(500, None, 0), (501, [0.0] * 12, 0), (502, [float("nan")] + [1.0] * 11, 0), (503, [None] + [1.0] * 11, 0)]
    rows += [(504, rows[0][1], None), (505, [], 0), (506, [1.0, 2.0], 0), (507, [1.0, 2.0], 0), (508, [1e300, -1e300], 0)]
    want = brute_links([r for r in rows if r[0] != 508])
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[0], (None, rows[0][1], 0)]], "vec_id long, embedding array<double>, label int, h1 string")
    got = vector_dedup.link(frame).collect()
    assert len(got) == len(rows) + 2
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id not in (508, None)} == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert vector_dedup.link(frame.limit(0)).count() == 0


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_classes(rows, size, percent):
    """rows: (id, text) -> id: (n_shingles, component)."""
    sets = {i: shingles(t, size) for i, t in rows}
    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {(i, j) for who in owners.values() for k, i in enumerate(who) for j in who[:k]}
    linked = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = classes(linked, list(sets))
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_documents_of_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9(spark, SF).collect()}
    assert got == brute_classes(rows, 3, 85)


def test_document_families(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 16)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for family in range(5):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 400]))]
        for _ in range([3, 90, 40, 1, 2][family]):
            share = rng.random() * 0.1
            rows.append((rng.randrange(10**9), " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (6, "É b"), (7, "é b"), (8, "x " * 30_000)]
    want = brute_classes(rows, 3, 85)
    frame = [*rows, rows[0], rows[0], (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in frame], "doc_id long, text string, row string")
    got = minhash.link(docs, shingle=3, threshold=0.85).collect()
    assert len(got) == len(frame)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = minhash.keep_first(docs, shingle=3, threshold=0.85)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}
    assert minhash.link(docs.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Rows that share an id, texts that are near copies under one id, and unlike texts under one id."""
    rng = random.Random(9)
    one, two = ([f"{c}{rng.randrange(500)}" for _ in range(60)] for c in "ab")
    near = " ".join([*one[:-1], "changed"])
    one, two = " ".join(one), " ".join(two)
    rows = [(5, one, 1), (5, one, 2), (5, near, 3), (5, two, 4), (5, two, 4), (9, one, 5), (1, "", 6), (1, "", 6), (None, one, 7), (None, one, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    kept = [tuple(r) for r in minhash.keep_first(docs).collect()]
    assert len([k for k in kept if k[0] == 5]) == 2 and {k[1] for k in kept if k[0] == 5} >= {two}
    assert sorted((k for k in kept if k[0] == 5 and k[1] == one)) in ([], [(5, one, 1)])
    assert not any(k[0] == 9 for k in kept) and len(kept) == 6


def test_estimates(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(900)]
    texts = [" ".join(words), " ".join(words[90:] + [f"u{k}" for k in range(90)]), " ".join(rng.sample(words, 900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = {r.id: r.bits for r in minhash.features(docs, 3).collect()}
    pairs = spark.createDataFrame([(bits[0], bits[k]) for k in range(3)], "a array<long>, b array<long>")
    found = [r[0] for r in pairs.select(minhash.estimate(pairs.a, pairs.b)).collect()]
    assert found[0] == 1 and abs(found[1] - 806 / 990) < 0.15 and abs(found[2]) < 0.2

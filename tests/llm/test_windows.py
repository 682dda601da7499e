"""Repeated windows of words against brute force."""

import random

import pytest
from brute import WORD, sha

from mealgrid.llm import windows


def brute(rows, width=20):
    """(id, text) -> sorted (id, n_words, n_removed, digest); equal rows are one document."""
    order = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({i for i, _ in order}) == len(order)
    seen, out = set(), {}
    for i, text in order:
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            if key in seen:
                gone.update(range(k, k + width))
            seen.add(key)
        out[i, text] = (i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted((out[r] for r in rows), key=str)


def shown(df, **options):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in windows.removals(df, **options).collect()), key=str)


def cases():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "ß x", "|", "W1"]
    draw = lambda n: rng.choices(vocabulary, k=n)
    passage = draw(90)
    texts = []
    for k in range(50):  # parts of one passage with other words around them, and other white space
        low = rng.randrange(60)
        words = draw(rng.randrange(30)) + passage[low : low + rng.randrange(15, 60)] + draw(25)
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in words))
    texts += [None, "", " \n", "few words", " ".join(passage), " ".join(passage), "\n".join(passage) + " "]
    texts += ["a " * 300, "b " * 20, "b " * 19, "a b " * 200, " ".join(passage[:20]), " ".join(passage[:19])]
    texts += [" ".join(draw(3_000) + passage + passage), "x" * 5_000]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (None, " ".join(passage[5:50]))]


@pytest.mark.parametrize("limits", [{}, {"HOT": 0, "SLACK": 0}, {"HOT": 0, "SLACK": 0, "SEEN": 5, "BLOCK": 400}, {"BLOCK": 1, "PIECE": 300, "BIN_BYTES": 100}])
def test_cases(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(windows, name, value)
    rows = cases()
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, row int, words string, bin int").repartition(5)
    want = brute(rows)
    assert shown(df) == want and sum(w[2] > 0 for w in want) > 30
    if not limits:
        assert shown(df.union(df)) == brute(rows * 2)
        assert shown(df, window=8, mark=2) == brute(rows, 8)
        left = windows.without_repeats(df).collect()
        assert len(left) == len(rows) and left[0].__fields__ == df.columns
        lost = {w[0]: w for w in want if w[2]}
        texts = dict(rows)
        assert all(sha(r.text) == lost[r.doc_id][3] if r.doc_id in lost else r.text == texts[r.doc_id] for r in left)
        assert shown(df.limit(0)) == []
        with pytest.raises(TypeError):
            windows.removals(df.selectExpr("'a' AS doc_id", "text"))


def test_hot_window_travels_once_per_task(spark, monkeypatch):
    """Many documents that share a passage with other edges send each of its windows once per task."""
    monkeypatch.setattr(windows, "HOT", 0)
    monkeypatch.setattr(windows, "SLACK", 0)
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices("abcdefghijk", k=9) + passage + rng.choices("abcdefghijk", k=9))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "id AS row", "text").repartition(2)
    import numpy as np

    sent = df.mapInArrow(windows._strings(20, 3, 64, np.full(4096, 255, np.uint8)), windows._SENT).collect()
    words = [w for r in sent for w in windows.unpack(r.n_strings, r.n_known, r.n_bytes, bytes(r.packed))[0]["words"]]
    assert words.count(" ".join(passage[:20]).encode()) == 2
    assert shown(df.withColumnRenamed("id", "doc_id")) == brute(rows)

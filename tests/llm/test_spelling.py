"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from mealgrid.llm import spelling


def counted(rows):
    total = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words, out, forms = counted(rows), [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            forms[w] = best
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, words[w], len(near[w]), words.get(forms.get(w))))
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in spelling.variants(df).collect())


def test_variants(spark):
    rng = random.Random(6)
    letters = "abàÿ÷e"
    base = ["".join(rng.choices(letters, k=rng.randrange(7, 11))) for _ in range(30)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab"]
    texts = []
    for _ in range(300):
        w = rng.choice(base[:: rng.choice([1, 5])])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
        texts.append(rng.choice([w, w.replace("a", "A"), w.replace("à", "À")]) + rng.choice([" ", "1", "$", "\n", "Ā"]) + w)
    # a chain of forms: counts of 2, 30, 400
    texts += ["chainab " * 2, "chainabc " * 30, "chainabcd " * 400, "short " * 9, "single-occurrence", "x" * 5_000 + " " + "x" * 5_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (None, ""), (900, None), (None, "chainab"), (5, texts[5])]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(rows)
    assert shown(df) == want
    assert ("chainab", "chainabc", "chainabcd") in {w[:3] for w in want} and max(w[4] for w in want) > 5
    assert shown(df.limit(0)) == []


@pytest.mark.parametrize("limits", [{"HELD": 1}, {"LISTED": 1}])
def test_limits_change_nothing(spark, monkeypatch, limits):
    rows = [(k, "wordings wordingz Wordings wordigs " * (1 + k % 3)) for k in range(40)]
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    assert shown(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_groups_are_bounded(spark):
    """However many words: a group has one row per letter and one whole rotation."""
    words = spark.createDataFrame([(f"abc{chr(97 + k % 26)}{chr(97 + k // 26)}xyz", 2 + k) for k in range(600)], "word string, n long")
    largest = spelling.rotations(words).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert largest <= 27

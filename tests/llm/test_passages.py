"""Repeated passages and lines against brute force."""

import hashlib
import random

import pytest

from brute import WORD, sha

from mealgrid.llm import line_dedup, queries, repeats

SF = "/root/testdata/sf0.01"


def brute_repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, digest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - length + 1):
            key = hash(d[k : k + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d in data:
        end, removed, spans, kept = 0, 0, 0, []
        at = 0
        for k in range(len(d) - length + 1):
            if seen[hash(d[k : k + length])] > 1:
                if k > end or not spans:
                    spans += 1
                    kept.append(d[at:k])
                    removed += length
                else:
                    removed += k + length - end
                end = at = k + length
        kept.append(d[at:])
        out.append((len(d), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
    return out


def test_passages_of_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in rows), brute_repeats([r.text for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10(spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("hot", [4, 20_000])
def test_passage_cases(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(8)
    letters = "abcdefgh é\n"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = draw(700)
    texts = [draw(rng.randrange(50)) + passage[a : a + rng.randrange(350, 700)] + draw(300) for a in range(0, 300, 12)]
    texts += [None, "", "short", passage, passage, "x" * 2000, "ab" * 900 + draw(20), draw(30) + "y" * 399, "z" * 400, "q" * 401]
    texts += [passage[:399] + draw(9), passage * 3, draw(5000)]
    docs = spark.createDataFrame([(k if k % 7 else None, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, row int")
    got = repeats.removals(docs).collect()
    shown = sorted((r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert shown == sorted(brute_repeats(texts))
    doubled = repeats.removals(docs.union(docs)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in doubled) == sorted(
        w[:2] for w in brute_repeats(texts * 2)
    )
    assert repeats.removals(docs.limit(0)).count() == 0


def brute_lines(rows):
    """rows: (id, text) in any order -> id: (n_lines, n_removed, digest); ids are distinct.

    A line goes when its words are similar to those of any earlier line.
    """
    seen, owners, out = [], {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            mine, hits = frozenset(WORD.findall(line)), {}
            for t in mine:
                for k in owners.get(t, ()):
                    hits[k] = hits.get(k, 0) + 1
            if not any(180 * c >= 80 * (len(mine) + len(seen[k])) for k, c in hits.items()):
                kept.append(line)
            if not any(c == len(mine) == len(seen[k]) for k, c in hits.items()):
                for t in mine:
                    owners.setdefault(t, []).append(len(seen))
                seen.append(mine)
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def test_lines_of_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op2(spark, SF).collect()}
    want = brute_lines(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("long", [3, 200])
def test_line_cases(spark, monkeypatch, long):
    monkeypatch.setattr(line_dedup, "LONG", long)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(30)]
    rows = []
    for k in range(60):  # many variants of one line
        line = [rng.choice(words) if rng.random() < 0.06 * rng.random() else w for w in base]
        rows.append((k * 3, "\n".join([" ".join(line), "short line", " ".join(rng.choices(words, k=12)), " ".join(line)])))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, rows[0][1]), (504, "a b " * 20_000), (505, "a b " * 20_000), (506, "a a a a a a a a a")]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, source string, row int, no int")
    out = line_dedup.remove_lines(docs).collect()
    want = brute_lines(rows)
    assert {r.doc.doc_id: (r.n_lines, r.n_removed, sha(r.doc.text or "")) for r in out} == want
    assert all(r.doc.source == "s" and r.doc.row == 1 for r in out) and sum(r.doc.text is None for r in out) == 1
    twice = line_dedup.remove_lines(docs.union(docs)).collect()
    assert {r.doc.doc_id: (r.n_lines, r.n_removed, sha(r.doc.text or "")) for r in twice} == want and len(twice) == 2 * len(rows)
    unnamed = spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1])], "doc_id long, text string")
    assert {r.doc.doc_id: r.n_removed for r in line_dedup.remove_lines(unnamed).collect()} == {None: 1, 1: 4}
    assert line_dedup.remove_lines(docs.limit(0)).count() == 0

"""Merkle manifest against a plain recursion."""

import hashlib
import zlib

import pytest

from mealgrid.llm import manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and for each node its siblings (left, right) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for way, (k, i) in zip(ways, enumerate(at)):
            run = runs[i // 16]
            way.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[k] = i // 16
        nodes = [digest("".join(run)) for run in runs]
    return nodes[0], ways


def brute(rows):
    """Rows in order of their leaves -> the columns of the trial."""
    groups = {}
    for row in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r))):
        groups.setdefault(row[1], []).append(row)
    if not rows:
        return []
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([leaf(r) for r in groups[s]]) for s in names]
    root, above = tree([s[0] for s in subs])
    out = []
    for name, (sub, ways), high in zip(names, subs, above):
        for row, way in zip(groups[name], ways):
            path = way + high
            now = leaf(row)
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0 and row[4] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                now = leaf((*row[:4], low))
            for left, right in path:
                now = digest(left + now + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((row[0], leaf(row), sub, root, proof, now, now == root))
    return out


def shown(df):
    return sorted((tuple(r) for r in manifest.trial(df).collect()), key=str)


def rows_of(n, source, start=0):
    texts = ["Abc Éa", "", None, "plain", "Ünï X" * 50]
    return [(start + k, source, "en" if k % 3 else None, k if k % 4 else None, texts[k % 5]) for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(300, "hot") + rows_of(17, None, 400) + rows_of(16, "é", 500) + rows_of(1, "z", 600) + rows_of(1, "", 700),
        [r for k in range(19) for r in rows_of(1 + k % 3, f"s{k}", 10 * k)],
        rows_of(40, "only"),
        rows_of(1, "only", 5),
        [*rows_of(5, "s"), *rows_of(5, "s"), (None, "s", None, None, "B"), (None, None, None, None, None), (3, "s", "en", 1, "other")],
        [],
    ],
)
def test_trees(spark, rows):
    df = spark.createDataFrame(rows, FIELDS)
    clash = df.selectExpr("*", "1 AS lo", "'x' AS digest", "2 AS n", "3 AS tree", "'y' AS path")
    assert shown(clash) == sorted(brute(rows), key=str)
    if len(rows) > 40:
        assert {w[6] for w in brute(rows)} == {True, False}


def test_proof_of_a_row(spark):
    """A stored proof tells a changed text from an unchanged one, without the rest of the table."""
    docs = spark.createDataFrame(rows_of(50, "a") + rows_of(20, "b", 100), FIELDS)
    row = manifest.manifest(docs).where("id = 101").first()
    assert (row.source, row["rank"]) == ("b", 1)

    def fold(start):
        for step in row.path:
            start = digest(step.left + start + step.right)
        return start

    (kept,) = [tuple(r) for r in docs.where("doc_id = 101").collect()]
    assert fold(leaf(kept)) == row.root and fold(leaf((*kept[:4], "changed"))) != row.root

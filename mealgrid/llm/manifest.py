"""Merkle manifest of a dataset: every row a leaf, a tree per source, and a tree over the sources' roots.

Nodes carry nested-interval labels: ``[lo, hi)``, the ranks of the leaves below them within their tree.

1. A leaf is the digest of its row's fields; one pass over the texts stores leaves, and only digests travel afterwards.
   Leaves are ranked over the whole table by range partitions (source, id, leaf), so that a source may hold any share of it.
2. Upwards, level by level: ``FAN`` consecutive nodes become one, whose interval covers theirs. Each level is a table of a
   sixteenth of the one before; a node keeps the labels and digests of its children.
3. Downwards: nodes attach to the ancestors whose intervals contain theirs. The join is bucketed by level: nodes of level k
   meet parents in the bucket ``lo div FAN^(k+1)`` of their tree, so a parent meets at most ``FAN`` nodes whatever the
   source's size. Siblings are the parent's children in the difference of the two intervals.
4. A proof is folded from any leaf digest by putting it between the siblings at its left and right, level by level.

Null fields are ``-``, others are UTF-8 byte count, ``:`` and value; empty texts are ``0:``. Null sources and null ids come
first; rows of one id are ordered by leaf, equal rows are leaves of their own with equal digests. A source of one row has
its leaf as root, one source alone gives the whole root, and an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.numbering import global_row_number
from mealgrid.core.scratch import written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_STEPS = "CAST(array() AS array<struct<left:string,right:string>>)"


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def levels(items: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels 1, 2, ... of all trees over items (tree, n, lo, digest); ``lo`` counts the n items of a tree from 0.

    A level holds (tree, n, lo, hi, digest, children) of every tree that reaches it.
    """
    largest = items.agg(F.max("n").alias("n")).first().n or 0
    below = items.withColumn("hi", F.col("lo") + 1)
    out, width = [], 1
    while width < largest:
        runs = (
            below.where(F.col("n") > width)
            .groupBy("tree", "n", F.floor(F.col("lo") / (width * fan)).alias("run"))
            .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        )
        below = written(
            runs.select(
                "tree", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
                F.sha2(_joined(F.col("children")), 256).alias("digest"), "children",
            ),
            "tree-level",
        )
        out.append(below)
        width *= fan
    return out


def _attached(nodes: DataFrame, above: DataFrame, width: int) -> DataFrame:
    """``nodes`` with the path, and the carried columns, of the parents whose intervals contain theirs."""
    n, p = nodes.alias("n"), above.alias("p")
    bucket = lambda side: F.floor(F.col(f"{side}.lo") / width)
    inside = (F.col("n.lo") >= F.col("p.lo")) & (F.col("n.hi") <= F.col("p.hi"))
    met = n.join(p, (F.col("n.tree") == F.col("p.tree")) & (bucket("n") == bucket("p")) & inside)
    left = F.filter("p.children", lambda c: c["hi"] <= F.col("n.lo"))
    right = F.filter("p.children", lambda c: c["lo"] >= F.col("n.hi"))
    step = F.struct(_joined(left).alias("left"), _joined(right).alias("right"))
    return met.select("n.*", F.concat(F.array(step), F.col("p.path")).alias("path"), "p.subroot", "p.root")


def paths(items: DataFrame, built: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """``items`` with the siblings up to the top; ``tops`` holds what lies above each tree: (tree, path, subroot, root)."""
    above = None
    for k in range(len(built) - 1, -1, -1):
        width = fan ** (k + 1)
        now = built[k].where(F.col("n") <= width).join(tops, "tree")
        if above is not None:
            now = now.unionByName(_attached(built[k].where(F.col("n") > width), above, width * fan))
        above = written(now, "tree-paths")
    rows = items.withColumn("hi", F.col("lo") + 1)
    found = rows.where("n = 1").join(tops, "tree")
    if above is not None:
        found = found.unionByName(_attached(rows.where("n > 1"), above, fan))
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, changed: Column | None = None) -> DataFrame:
    """(id, source, rank, leaf, changed, subroot, root, path) per row: its place in the tree of its source and its proof.

    ``rank`` counts the rows of a source from 0. ``changed`` may give another digest for each row, which is carried along.
    """
    leaves = written(
        docs.select(
            F.col(group_col).alias("source"),
            F.col(id_col).alias("id"),
            leaf_of([F.col(c) for c in fields]).alias("leaf"),
            (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
        ),
        "leaves",
    )
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    ranked = written(global_row_number(leaves, order, "at"), "ranked-leaves")
    spans = ranked.groupBy("source").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n"))
    spans = written(spans, "source-spans")  # its size is known then: broadcast where small, else a join that may be split
    items = ranked.join(spans, ranked["source"].eqNullSafe(spans["source"])).select(
        "tree", "n", (F.col("at") - F.col("tree")).alias("lo"), F.col("leaf").alias("digest"), "id", ranked["source"], "changed"
    )
    items = written(items, "tree-leaves")
    built = levels(items.select("tree", "n", "lo", "digest"))

    tree_roots = [items.where("n = 1").select("tree", "digest")]
    tree_roots += [t.where(F.col("n").between(FAN**k + 1, FAN ** (k + 1))).select("tree", "digest") for k, t in enumerate(built)]
    roots = tree_roots[0]
    for more in tree_roots[1:]:
        roots = roots.union(more)
    # trees are numbered by the rank of their first leaf, which is the order of sources
    numbered = written(global_row_number(roots, [F.col("tree")], "nth"), "subroots")
    whole = numbered.select(
        F.lit(0).cast("long").alias("tree"), F.lit(numbered.count()).cast("long").alias("n"), (F.col("nth") - 1).alias("lo"), "digest", F.col("tree").alias("of")
    )
    top = levels(whole.select("tree", "n", "lo", "digest"))
    root = (top[-1] if top else whole).limit(1).select(F.col("digest").alias("root"))
    apex = root.select(F.lit(0).cast("long").alias("tree"), F.expr(NO_STEPS).alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
    tops = paths(whole, top, written(apex, "apex")).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = paths(items, built, written(tops, "source-paths"))
    return found.select("id", "source", F.col("lo").alias("rank"), F.col("digest").alias("leaf"), "changed", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings from the leaf's level to the top, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def is_tampered(row_id: Column) -> Column:
    """Whether a trial changes this row; a null id reads as no text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % 5 == 0


def trial(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, checked after some texts were lower-cased: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    after = [lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    rows = manifest(docs, changed=F.when(is_tampered(F.col("doc_id")), leaf_of(after)))
    told = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return told.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )

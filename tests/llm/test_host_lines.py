"""Frequent lines of small and hot hosts, with the defaults of the query."""

from pyspark.sql import functions as F

from mealgrid.llm import quality_rules, queries

WORDS = "every document has these twenty different words {0} so that none of the base rules can fail it by count {0}a b{0} c{0} d{0} e{0} f{0}"


def documents(folder, spark):
    notice = " ".join(f"notice number {k} of the host" for k in range(60))
    rows = []
    for host, size, depleted, rare in (("small", 60, 8, 5), ("hot", 3000, 200, 25), (None, 40, 9, 2)):
        for k in range(size):
            head = f"{notice} {host}\n" if k < depleted else f"{notice} rare {host}\n" if k < depleted + rare else ""
            rows.append((len(rows), head + WORDS.format(f"{host}{k}"), host))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return {r[0] for r in rows if f"{notice} {r[2]}\n" in r[1]}


def test_share_of_host(spark, tmp_path):
    depleted = documents(str(tmp_path), spark)
    got = queries.op8(spark, str(tmp_path)).collect()
    assert len(got) == 3100 and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == depleted


def test_frequent_lines_are_removed(spark):
    """Texts lose the marked lines of their host, and what is left agrees with the share that the verdict uses."""
    rows = [(i, f"Top line\nown words of document {i}\n\n top LINE \nend", "a") for i in range(30)]
    rows += [(100 + i, f"Top line\nother host {i}", "b" if i else None) for i in range(6)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "Top line", "a"), (None, "top line\nx", "a"), (0, rows[0][1], "a")]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, source string, n_removed int, gone string")
    got = quality_rules.without_frequent_lines(docs, max_docs=8).select("doc.*", F.col("n_removed").alias("n"), "left_share").collect()
    assert len(got) == len(rows) and got[0].__fields__[:5] == docs.columns

    def left(text, host):
        if host != "a" or text is None:
            return text
        kept = [x for x in text.split("\n") if x.strip().lower() not in ("top line", "end")]
        return "\n".join(kept)

    want = {(i, t, h): left(t, h) for i, t, h in rows}
    for r in got:
        (source,) = [k for k in want if k[0] == r.doc_id and k[2] == r.source]
        assert r.text == want[source] and r.n == len((source[1] or "").split("\n")) - len((r.text or "").split("\n")) + (r.text == "" != source[1])
    judged = quality_rules.verdicts(docs, max_docs=8)
    assert {r.doc_id: r.left_share for r in judged.collect()} == {r.doc_id: r.left_share for r in got}
    assert {r.doc_id: r.left_share for r in got}[202] == 0
    assert quality_rules.without_frequent_lines(docs.limit(0)).count() == 0

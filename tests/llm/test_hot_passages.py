"""Passages whose edges many documents share: no task gathers more contexts of a bucket than the limit."""

import random

from test_passages import brute_repeats

from mealgrid.llm import repeats


def test_group_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    whole = repeats._repeated

    def watched(length):
        run = whole(length)

        def settle(frame):
            if frame.groupby("bucket").size().max() > 20:
                raise ValueError("one bucket is gathered whole")
            return run(frame)

        return settle

    monkeypatch.setattr(repeats, "_repeated", watched)
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = draw(900)
    texts = [draw(80) + passage + draw(80) for _ in range(60)] + [passage[:430] + draw(40), draw(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.removals(docs).collect())
    assert got == sorted(brute_repeats(texts))

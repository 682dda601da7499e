"""Text expressions and screening on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from mealgrid.functions import catalog_values, recipe_text, storage, text
from mealgrid.operators import screening, vectors, wordsearch
from mealgrid.sources import dumps, exchange


def evaluate(spark, expression, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_keys_and_clean_text(spark):
    assert evaluate(spark, text.match_key, "베이킹 파우더", " A b\tC ") == ["베이킹파우더", "abc"]
    assert evaluate(spark, text.cluster_key, "  Vanilla \n Extract ") == ["vanilla extract"]
    assert evaluate(spark, text.clean_text, " None ", "-", "nan", " x ") == [None, None, None, "x"]


def test_numbers(spark):
    number = lambda c: catalog_values.clean_number(c, 2).cast("string")
    assert evaluate(spark, number, "1,234.5원", "abc", "1-2", "nan", "-3") == ["1234.50", None, None, None, "-3.00"]


def test_weights(spark):
    df = spark.createDataFrame(
        [(0, "1", "유기농황설탕 1kg"), (1, "5", "우유 900ml"), (2, "7", "김치"), (3, "2", "새우살 200g"), (4, "9", "오일 0,5 KG")],
        "i int, v string, n string",
    )
    rows = df.orderBy("i").select(catalog_values.weight_grams(F.col("v"), F.col("n")).cast("double").alias("x"))
    assert [r.x for r in rows.collect()] == [1000.0, None, 7.0, 200.0, 500.0]


def test_json_values(spark):
    assert evaluate(spark, catalog_values.json_or_raw, '{"a": NaN, "b": "x: NaN, y"}', "oops", "[1]", "none") == [
        '{"a":null,"b":"x: NaN, y"}', '{"raw":"oops"}', '{"raw":[1]}', "{}"]


def test_cooking_methods(spark):
    assert evaluate(spark, recipe_text.cooking_method, "볶음, 조림", "에어프라이어구이", "조리", "조리 (가열 및 혼합)") == [
        "볶음", "에어프라이어", None, "무침"]


def test_steps(spark):
    assert evaluate(spark, recipe_text.clean_step, "1. 건진다.a", "12. 물 200g", "끓인다.") == ["건진다.", "물 200g", "끓인다."]


def test_quantities(spark):
    values = ["75g", "1/2알", "1 1/2컵", "½큰술", "1½컵", "3/0", "약간", "2.5 g", ""]
    assert evaluate(spark, recipe_text.quantity_value, *values) == [75.0, 0.5, 1.5, 0.5, 1.5, None, None, 2.5, None]
    assert evaluate(spark, recipe_text.quantity_unit, "75g", "1/2알", "3") == ["g", "알", None]


def test_ingredient_lines(spark):
    raw = "●방울토마토 소박이 :\n방울토마토 150g(5개), 양파 10g(3x1cm), 부추 10g(5줄기)<br>●양념장 :\n고춧가루 4g(1작은술), 양파 5g, 참깨 약간"
    df = spark.createDataFrame([("r1", raw)], "id string, t string")
    rows = recipe_text.parse_ingredient_lines(df, "id", "t").orderBy("line_no").collect()
    assert [(r.line_no, r.name, r.quantity) for r in rows] == [
        (1, "방울토마토", "150g"), (2, "양파", "10g"), (3, "부추", "10g"), (4, "고춧가루", "4g"), (5, "참깨", "")]


def test_candidates(spark):
    assert evaluate(spark, recipe_text.match_candidates, "다진 마늘", "올리브오일", "무") == [
        ["다진 마늘", "마늘"], ["올리브오일", "올리브유"], ["무"]]


def test_labels(spark):
    assert evaluate(spark, storage.product_storage, "COLD", "냉동", "x", None) == ["냉장", "냉동", None, None]
    assert evaluate(spark, storage.duration_unit, "Years", "When Ripe", " ", "주") == ["년", "When Ripe", None, "주"]
    assert evaluate(spark, text.object_particle, "김치", "된장국", "A", "두부(B)") == ["를", "을", "을", "를"]


def test_copy_fields(spark):
    raw = ["\\N", "a\\tb", "x\\\\n", "\\\\\\t", "plain", "q\\z"]
    assert evaluate(spark, dumps.copy_field, *raw) == [None, "a\tb", "x\\n", "\\\t", "plain", "q\\z"]


def test_cut_off_dump_is_refused(spark, tmp_path):
    (tmp_path / "d.sql").write_text("COPY public.t (a, b) FROM stdin;\n1\t2\n", encoding="utf-8")
    with pytest.raises(Exception, match="cut off"):
        dumps.read_copy_dump(spark, str(tmp_path), "t", ["a", "b"]).collect()
    with pytest.raises(Exception, match="no COPY block"):
        dumps.read_copy_dump(spark, str(tmp_path), "u", ["a"]).collect()


@pytest.mark.parametrize("block", [7, 20, 50, 1000])
def test_request_parts_are_one_greedy_pass(spark, block):
    requests = spark.range(200).selectExpr("id AS custom_id", "repeat('x', CAST(10 + id * 37 % 90 AS INT)) AS text")
    got = {r.custom_id: (r.part_no, r.tokens) for r in exchange.request_parts(requests, ["custom_id"], 7, 100, block=block).collect()}
    want, part, count, used = {}, 1, 0, 0
    for k in range(200):
        size = int((10 + k * 37 % 90) / 2.5) + 1
        if count and (count >= 7 or used + size > 100):
            part, count, used = part + 1, 0, 0
        want[k], count, used = (part, size), count + 1, used + size
    assert got == want


def test_requests_that_no_part_holds(spark):
    requests = spark.createDataFrame([(1, "x" * 100), (2, "y"), (2, "y")], "custom_id long, text string")
    assert exchange.request_parts(requests, ["custom_id"], 7, 20).count() == 2
    rejects = {r.custom_id: r.reason for r in exchange.request_rejects(requests, 20).collect()}
    assert rejects == {1: "over the token limit", 2: "repeated id"}


def test_closure_of_a_long_chain(spark):
    from mealgrid.operators.hierarchy import ancestors

    chain = spark.range(1, 301).selectExpr("id AS ingredient_id", "CASE WHEN id > 1 THEN id - 1 END AS parent_ingredient_id")
    assert ancestors(chain).filter("ingredient_id = 300").count() == 300


def test_block_search_equals_scan(spark):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.array(*[F.sin(F.col("id") * k + k) for k in range(1, 5)]).alias("embedding")
    )
    queries = docs.filter("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    for metric in (vectors.COSINE, vectors.L2, vectors.INNER):
        scan = vectors.vector_topk(queries, docs, 4, -1e9, metric)
        blocks = vectors.vector_topk(queries, docs, 4, -1e9, metric, small=4, block=25)
        key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
        assert key(scan) == key(blocks)


@pytest.mark.parametrize("metric", [vectors.COSINE, vectors.L2, vectors.INNER])
def test_cells_equal_scan_and_prune(spark, metric):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 5
    docs = np.concatenate([c + rng.normal(size=(60, 8)) * 0.2 for c in centres] + [np.zeros((2, 8)), centres[:1], centres[:1]])
    asked = np.concatenate([centres + 0.1, docs[::37], np.zeros((1, 8))])
    if metric == vectors.COSINE:  # no angle, no order
        docs, asked = docs[np.any(docs != 0, axis=1)], asked[:-1]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(docs)] + [(9_999, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id long, embedding array<double>")
    want = vectors.vector_topk(q, d, 5, -1e9, metric)
    got = vectors.vector_topk(q, d, 5, -1e9, metric, small=3, block=50)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    assert key(want) == key(got)
    assert vectors.vector_topk(q, d.limit(0), 5, -1e9, metric, small=3).count() == 0
    cells = vectors._Cells(np.array([]), metric)
    cells.pivots = cells.unit(centres)
    cell, gap = cells.place(docs)
    cells.summarise([(c, r + 1, g, gap[cell == c].max()) for c in set(cell) for r, g in enumerate(sorted(gap[cell == c])[:5])], 5)
    assert sum(len(cells.wanted(v)) for v in centres) <= 12  # of 36 pairs of query and cell


def test_longest_key_in_long_texts(spark, monkeypatch):
    import random

    from mealgrid.plans import resolve

    monkeypatch.setattr(resolve, "CHUNK", 8)
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choice("가나다ab") for _ in range(n))
    keys = [(k, i, i) for i, k in enumerate(dict.fromkeys(draw(rng.randrange(1, 9)) for _ in range(120)))]
    names = [draw(n) for n in (0, 1, 2, 7, 30, 200, 900)] * 2
    products = spark.createDataFrame([(i, n, "식품>" + n[:5]) for i, n in enumerate(names)], "product_id long, name string, category_path string")
    lookup = spark.createDataFrame(keys, "key string, ingredient_id long, key_order long")
    got = {r.product_id: r.key for r in resolve.links_from_names(products, lookup).collect()}
    from mealgrid.functions import fixed_values as fixed

    for i, name in enumerate(names):
        inside = [k for k, _, order in keys if len(k) >= fixed.MIN_SUBSTRING and k in name]
        best = min(inside, key=lambda k: (-len(k), [o for x, _, o in keys if x == k][0]), default=None)
        assert best is None or got[i] == best


CARD = "card_id long, request_id long, recipe string, have array<string>, missing array<string>, pantry array<string>, cook_time int, reason string"
GOOD = "잘 익은 김치와 돼지고기를 살려 오늘 저녁 든든하게 끓이기 좋아요. 두부만 더 담으면 한 상이 완성돼요."


def failed(spark, reason, words=(), recipe="김치찌개", have=("김치", "돼지고기"), missing=("두부",), pantry=("소금",), others=()):
    cards = [(1, 1, recipe, list(have), list(missing), list(pantry), None, reason), *others]
    vocabulary = spark.createDataFrame([(x,) for x in words] or [("없는말",)], "word string")
    rows = screening.checked(spark.createDataFrame(cards, CARD), vocabulary).filter("card_id = 1").collect()
    return rows[0].failed


def test_good_text_passes(spark):
    assert failed(spark, GOOD, words=["두부", "대파", "김치"]) == []


def test_vocabulary_word_outside_the_card(spark):
    assert "환각_재료" in failed(spark, GOOD.replace("두부만", "대파만 두부만"), words=["대파"])
    assert failed(spark, GOOD, words=["부"]) == []


def test_other_card(spark):
    other = (2, 1, "전골", ["버섯"], [], [], None, GOOD)
    assert "다른카드_재료혼입" in failed(spark, GOOD.replace("두부만", "버섯과 두부만"), others=[other])


def test_flipped_and_pantry(spark):
    assert "보유_뒤집힘" in failed(spark, GOOD.replace("두부만 더 담으면", "두부가 있으니 두부만 담으면"))
    assert "보유_뒤집힘" not in failed(spark, GOOD.replace("두부만 더 담으면", "두부가 있으면"))
    assert "상비재료_구매유도" in failed(spark, GOOD.replace("두부만", "소금을 사고 두부만"))


def test_ambiguous_word_is_not_an_ingredient(spark):
    reason = GOOD.replace("두부만", "두 가지 재료 두부만")
    assert "환각_재료" not in failed(spark, reason, words=["가지"])
    assert "환각_재료" in failed(spark, GOOD.replace("두부만", "가지와 두부만"), words=["가지"])


def test_title_is_masked_but_longer_names_stay(spark):
    reason = "라자냐면과 치즈를 살려 오늘 저녁 라자냐 한 접시를 근사하게 차려 보기 좋아요. 토마토만 더 담으면 됩니다."
    kept = failed(spark, reason, recipe="라자냐", have=("라자냐면", "치즈"), missing=("토마토",), pantry=())
    assert kept == []


def test_form_and_planted_content(spark):
    assert "출력_형식오류" in failed(spark, GOOD + " 셋째 문장이에요.")
    assert "링크_삽입" in failed(spark, GOOD.replace("두부만", "www.x.kr 두부만"))
    assert "입력에_없는_영문숫자" in failed(spark, GOOD.replace("두부만", "ZX9731 두부만"))
    assert "음식안전_비방" in failed(spark, GOOD.replace("두부만", "상해서 두부만"))
    assert "빈_문구" in failed(spark, "  ")


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_words_across_chunks_equal_brute_force(spark, monkeypatch, limit):
    from mealgrid.core import sizes

    texts = {i: ("가나다 라마 " * 40 + "red gear " + "x" * (250 + i) + "파프리카 끝 blue bolt") for i in range(8)}
    words = ["red gear", "파프리카", "blue bolt", "라마", "xx끝", "x" * 20, "gear xx", "없음", "가"]
    cards = spark.createDataFrame(list(texts.items()), "card_id long, reason string")
    monkeypatch.setattr(screening, "broadcast_if_small", lambda df: sizes.broadcast_if_small(df, limit))
    found = screening.words_in_texts(cards, spark.createDataFrame([(x,) for x in words], "word string")).collect()
    expected = {i: sorted(x for x in words if len(x) >= 2 and x in t) for i, t in texts.items()}
    assert {r.card_id: sorted(r.words) for r in found} == expected


def _rows_of_words(found):
    return sorted((str(r.card_id), r.words) for r in found.collect())


@pytest.mark.parametrize("segment, cells", [(3, 8), (512, 1 << 22)])
def test_a_small_vocabulary_is_sought_in_one_pass(spark, monkeypatch, segment, cells):
    monkeypatch.setattr(wordsearch, "SEGMENT", segment)
    monkeypatch.setattr(wordsearch, "STEP_CELLS", cells)
    # endings of other words, several bytes a character, keys that repeat or are null, texts without any word
    words = ["abc", "bc", "cab", "가나", "나다", "가나다", "😀b", "a", "", None, "\n|", "zz"]
    rows = [(1, "xabcab"), (1, "가나다"), (2, "b\n|😀b"), (None, "bcbc"), (3, "none"), (4, ""), (5, None), (6, "ab" * 700 + "c가나" + "다" * 9)]
    cards = spark.createDataFrame(rows, "card_id long, reason string")
    frame = spark.createDataFrame([(x,) for x in words + words], "word string")
    expected = {}
    for i, t in rows:
        expected.setdefault(i, set()).update(x for x in words if x and len(x) >= 2 and t and x in t)
    want = sorted((str(i), sorted(x, key=str.encode)) for i, x in expected.items() if x)
    found = screening.words_in_texts(cards, frame)
    assert found.columns == ["card_id", "words"]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # pieces of texts are not unfolded
    assert _rows_of_words(found) == want
    monkeypatch.setattr(wordsearch, "WORDS", 0)
    assert _rows_of_words(screening.words_in_texts(cards, frame)) == want
    monkeypatch.setattr(wordsearch, "WORDS", 32_000)
    monkeypatch.setattr(wordsearch, "TABLE_CELLS", 10)
    assert _rows_of_words(screening.words_in_texts(cards, frame)) == want

"""Rule checks over recommendation texts.

Input rows: card_id, request_id, recipe, have, missing, pantry (name arrays), cook_time and reason
(the text). Every rule is a column expression; only the search for vocabulary words needs a join.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.ranking import ranked
from mealgrid.core.scratch import durable
from mealgrid.core.sizes import broadcast_if_small
from mealgrid.core.spread import spread
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.reasons import template_reason
from mealgrid.functions.text import object_particle
from mealgrid.functions.text import quoted_regex, stripped, unicode_pattern
from mealgrid.operators import wordsearch

def _none() -> Column:
    return F.array().cast("array<string>")


def effective_missing() -> Column:
    """Missing names without pantry staples."""
    return F.filter("missing", lambda n: ~F.array_contains(F.col("pantry"), n))


def known_names() -> Column:
    """Every ingredient the text may speak about."""
    return F.array_distinct(F.concat("have", "missing", "pantry"))


def vocabulary(cards: DataFrame) -> DataFrame:
    """Distinct ingredient names over all situations."""
    return cards.select(F.explode(known_names()).alias("word")).distinct()


# ---------------------------------------------------------------- names inside texts


def _word(name: Column) -> Column:
    return F.concat(F.lit(fixed.NOT_AFTER_HANGUL), quoted_regex(name))


def says(text: Column, name: Column, tail: str = "") -> Column:
    """The text has the name at the start of a word, followed by ``tail`` (a pattern)."""
    return F.contains(text, name) & F.rlike(text, F.concat(_word(name), F.lit(tail)))


def claims(text: Column, name: Column, verbs: str, gap: str = r"\s*") -> Column:
    """The name, an optional particle, a gap, then one of the verbs."""
    return says(text, name, fixed.PARTICLES + unicode_pattern(gap) + verbs)


def out_of_place(words: Column, spare_title: bool = True) -> Column:
    """Those of ``words`` that a text uses as an ingredient of its own.

    Not counted: pieces of a longer known name, other meanings of ambiguous words, and, to ``spare_title``, words of the
    recipe title of which the text does not say that they are there, lacking or to be bought.
    """
    known, scan, recipe = F.col("known"), F.col("scan"), F.col("recipe")
    near = "[^.!?。？！\n]{0,10}"

    def is_meant(word: Column) -> Column:
        other_meaning = reduce(
            lambda rest, entry: F.when(word == entry[0], ~says(F.regexp_replace(scan, unicode_pattern(entry[1]), " "), word)).otherwise(rest),
            fixed.AMBIGUOUS_WORDS.items(),
            F.lit(False),
        )
        spoken_of = [claims(scan, word, verbs, near) for verbs in (fixed.HAS_WORDS, fixed.LACKS_WORDS, fixed.BUY_WORDS)]
        in_title = F.contains(recipe, word) & ~reduce(Column.__or__, spoken_of)
        in_longer = F.exists(known, lambda n: (n != word) & F.contains(n, word))
        meant = says(scan, word) & ~in_longer & ~other_meaning
        return meant & ~in_title if spare_title else meant

    return F.array_sort(F.filter(words, is_meant))


def name_aliases(name: Column) -> Column:
    """The name; for ``a(b)`` also ``a`` and ``b``."""
    base = stripped(F.regexp_extract(name, r"^([^(]*)\(", 1))
    inner = stripped(F.regexp_extract(name, r"^[^(]*\((.*)\)$", 1))
    split = F.filter(F.array(name, base, inner), lambda p: p != "")
    return F.when(F.contains(name, F.lit("(")) & name.endswith(")"), split).otherwise(F.array(name))


def mentioned(name: Column, text: Column, others: Column) -> Column:
    """The name or an alias is in the text; the last two characters of a long alias also count,
    unless another known name contains them."""

    def said(alias: Column) -> Column:
        suffix = F.right(alias, F.lit(2))
        free = ~F.exists(others, lambda o: (o != name) & F.contains(o, suffix))
        whole = F.contains(text, alias) & F.rlike(text, _word(alias))
        return whole | ((F.length(alias) > 2) & F.contains(text, suffix) & free)

    return F.exists(name_aliases(name), said)


def without_title(text: Column, recipe: Column, names: Column) -> Column:
    """The text with quotes of the recipe title blanked, except inside longer names from ``names``."""
    mark = "\u0001"
    longer = F.array_sort(
        F.array_distinct(F.filter(names, lambda n: F.contains(n, recipe) & (n != recipe))),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).otherwise(1),
    )
    kept = F.array_join(F.transform(longer, quoted_regex), "|")
    either = F.concat(F.lit("("), kept, F.lit(")|"), quoted_regex(recipe))
    marked = F.regexp_replace(text, either, F.lit("$1" + mark))
    restored = F.regexp_replace(marked, F.concat(F.lit("("), kept, F.lit(")" + mark)), F.lit("$1"))
    masked = F.when(F.size(longer) == 0, F.replace(text, recipe, F.lit(" "))).otherwise(
        F.replace(restored, F.lit(mark), F.lit(" "))
    )
    return F.when(recipe == "", text).otherwise(masked)


# ---------------------------------------------------------------- preparation


CHUNK = 256
HEAD = 4  # leading characters by which a word is looked up


def words_in_texts(cards: DataFrame, words: DataFrame) -> DataFrame:
    """(card_id, words): vocabulary words of two or more characters that occur in each text.

    A vocabulary that was measured to fit one table is sought by an automaton in a single pass over the texts. Larger ones are
    joined: texts are cut into chunks that overlap by the longest word, so long texts spread over tasks. A word is looked up by
    its first ``HEAD`` characters: each chunk unfolds its distinct pieces of at most that length, meets the vocabulary in an
    equi-join, and is then searched for the words that start so. The words of one card are bounded by its own text.
    """
    head = F.substring("word", 1, HEAD)
    lexicon = durable(words.filter(F.length("word") >= 2).select("word").distinct().withColumn("head", head))
    known = lexicon.agg(
        F.array_sort(F.collect_set(F.length("head"))).alias("lengths"), F.max(F.length("word")).alias("longest"),
        F.count("word").alias("words"), F.sum(F.octet_length("word")).alias("bytes"),
        F.bool_and(F.is_valid_utf8("word")).alias("readable"),
    ).first()
    if not known["lengths"]:
        return cards.select("card_id", _none().alias("words")).filter(F.lit(False))
    if known["readable"] and known["words"] <= wordsearch.WORDS and known["bytes"] <= wordsearch.WORD_BYTES:
        sought = wordsearch.automaton([r.word for r in lexicon.select("word").collect()])
        if sought is not None:
            return wordsearch.words_found(cards, "card_id", "reason", sought)
    chunks = (
        cards.select("card_id", F.col("reason").alias("t"))
        .filter(F.length("t") >= 2)
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.length("t"), F.lit(CHUNK))))
        .withColumn("chunk", F.substring(F.col("t"), F.col("start"), F.lit(CHUNK - 1 + known["longest"])))
        .select("card_id", "start", "chunk")
    )
    starts = F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(CHUNK)))

    def of_length(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(F.col("chunk"), i, F.lit(n)))

    pieces = F.concat(*[of_length(n) for n in known["lengths"]])
    return (
        spread(chunks, "card_id", "start")
        .select("card_id", "chunk", F.explode(F.array_distinct(pieces)).alias("head"))
        .join(broadcast_if_small(lexicon), "head")
        .filter(F.contains("chunk", "word"))
        .select("card_id", "word")
        .distinct()
        .groupBy("card_id")
        .agg(F.array_sort(F.collect_list("word")).alias("words"))
    )


def prepared(cards: DataFrame, words: DataFrame) -> DataFrame:
    """Cards with foreign names (other cards of the request), vocabulary words found, and masked text.

    A request has few cards: only the first ones are generated, the rest use the rule text.
    """
    in_request = (
        cards.select("request_id", F.explode(known_names()).alias("name"))
        .distinct()
        .groupBy("request_id")
        .agg(F.collect_list("name").alias("request_names"))
    )
    rows = (
        cards.join(in_request, "request_id", "left")
        .join(words_in_texts(cards, words), "card_id", "left")
        .withColumn("words", F.coalesce("words", _none()))
        .withColumn("known", known_names())
        .withColumn("foreign", F.array_sort(F.array_except(F.coalesce("request_names", _none()), "known")))
        .withColumn("absent", effective_missing())
        .drop("request_names")
    )
    names = F.concat("known", "foreign", "words")
    return rows.withColumn("scan", without_title(F.col("reason"), F.col("recipe"), names))


# ---------------------------------------------------------------- rules: NULL when passed, else the detail


def _listed(bad: Column, separator: str = ", ") -> Column:
    return F.nullif(F.array_join(bad, separator), F.lit(""))


class Pattern(NamedTuple):
    """A rule that a text must not match a pattern; the match is the detail."""

    scope: str
    pattern: str
    ignore_case: bool = False
    only_without: str | None = None  # a column that allows it by being there

    def detail(self) -> Column:
        flags = "(?i)" if self.ignore_case else ""
        match = F.nullif(F.regexp_extract(self.scope, flags + unicode_pattern(self.pattern), 0), F.lit(""))
        return match if self.only_without is None else F.when(F.col(self.only_without).isNull(), match)


class Claims(NamedTuple):
    """A rule that a text must not claim something of some names: pairs of names and verbs."""

    wrong: tuple[tuple[str, str], ...]

    def detail(self) -> Column:
        return _listed(F.concat(*[self._claimed(*entry) for entry in self.wrong]))

    def _claimed(self, names: str, verbs: str) -> Column:
        return F.filter(names, lambda n: claims(F.col("scan"), n, verbs))


class Length(NamedTuple):
    """A rule on the number of characters of a text that is not empty."""

    least: int = 0
    most: int | None = None

    def detail(self) -> Column:
        n = F.length("reason")
        bad = n < self.least if self.most is None else n > self.most
        return F.when(bad & (F.lit(self.most is not None) | ~_is_empty()), F.concat(n.cast("string"), F.lit("자")))


def other_card_ingredients() -> Column:
    """An ingredient of another card of the request."""
    return _listed(out_of_place(F.col("foreign")))


def invented_ingredients() -> Column:
    """A vocabulary word that is in no card of the request."""
    return _listed(out_of_place(F.array_except(F.array_except("words", "known"), "foreign")))


def _is_empty() -> Column:
    return stripped(F.col("reason")) == ""


def empty_text() -> Column:
    """Nothing but white space."""
    return F.when(_is_empty(), F.lit(""))


def sentence_count() -> Column:
    """Number of sentence endings."""
    return F.size(F.regexp_extract_all(stripped(F.col("reason")), F.lit(fixed.SENTENCE_END), F.lit(0)))


def is_malformed() -> Column:
    """Not exactly two sentences in one plain paragraph."""
    text = F.col("reason")
    return ~_is_empty() & (
        text.rlike("[\n\r]")
        | (F.col("sentences") != fixed.SENTENCES)
        | text.rlike(unicode_pattern(fixed.MARKUP_START))
    )


def malformed() -> Column:
    """10: form."""
    return F.when(F.col("bad_form"), F.concat(F.col("sentences").cast("string"), F.lit("문장")))


def roles_apply() -> Column:
    """Sentence roles are only looked at in well-formed texts."""
    return ~_is_empty() & ~F.col("bad_form")


def sentence_roles() -> Column:
    """11: first sentence on what is there, second on what to add."""
    sentences = F.filter(
        F.split(stripped(F.col("scan")), unicode_pattern(fixed.SENTENCE_GAP)), lambda s: s != ""
    )
    first = F.coalesce(F.try_element_at(sentences, F.lit(1)), F.lit(""))
    rest = F.array_join(F.slice(sentences, 2, F.greatest(F.size(sentences), F.lit(1))), " ")
    known, absent = F.col("known"), F.col("absent")
    unsaid = F.array_join(F.filter(absent, lambda n: ~mentioned(n, rest, known)), ", ")
    no_hint = ~F.contains(rest, F.lit("가지")) & ~F.contains(rest, F.lit("재료"))
    second = F.when(
        F.size(absent).between(1, 3), F.concat(F.lit("둘째 문장에 빠진 부족 재료: "), F.nullif(unsaid, F.lit("")))
    ).when(
        (F.size(absent) >= 4) & no_hint,
        F.when(F.nullif(unsaid, F.lit("")).isNotNull(), "둘째 문장에 부족 재료 안내가 없음"),
    )
    no_have = (F.size("have") > 0) & ~F.exists("have", lambda n: mentioned(n, first, known))
    early = F.exists(absent, lambda n: mentioned(n, first, known))
    problems = F.array_compact(
        F.array(
            F.when(no_have, "첫 문장에 보유 재료가 없음"), F.when(early, "첫 문장에 부족 재료가 있음"), second
        )
    )
    return F.when(roles_apply(), _listed(problems, "; "))


def _ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.ASCII_TOKEN), F.lit(0))


def foreign_tokens() -> Column:
    """12: Latin letters or digits that are not in the input."""
    minutes = F.when(F.coalesce("cook_time", F.lit(0)) != 0, F.col("cook_time").cast("string"))
    fields = F.array_join(F.array_compact(F.concat(F.array("recipe"), F.col("known"), F.array(minutes))), "\n")
    allowed = _ascii_tokens(F.lower(fields))
    used = F.array_distinct(_ascii_tokens(F.col("scan")))
    return _listed(F.array_sort(F.filter(used, lambda t: ~F.array_contains(allowed, F.lower(t)))))


FLIPPED = Claims((("absent", fixed.HAS_WORDS), ("have", fixed.LACKS_WORDS)))
STAPLES_BOUGHT = Claims((("pantry", fixed.BUY_WORDS),))
INVENTED_TIME = Pattern("reason", fixed.TIME_MENTION, only_without="cook_time")

#: Name of each rule, in order, and what finds its fault: null when there is none, else the detail.
RULES = {
    "다른카드_재료혼입": other_card_ingredients,
    "환각_재료": invented_ingredients,
    "보유_뒤집힘": FLIPPED.detail,
    "상비재료_구매유도": STAPLES_BOUGHT.detail,
    "조리시간_지어냄": INVENTED_TIME.detail,
    "근거_없는_영양건강주장": Pattern("scan", fixed.HEALTH_CLAIM, ignore_case=True).detail,
    "숫자_반복": Pattern("reason", fixed.RATIO_OR_COUNT).detail,
    "길이초과": Length(most=fixed.MAX_TEXT).detail,
    "길이미달": Length(least=fixed.MIN_TEXT).detail,
    "빈_문구": empty_text,
    "출력_형식오류": malformed,
    "문장_역할": sentence_roles,
    "입력에_없는_영문숫자": foreign_tokens,
    "링크_삽입": Pattern("reason", fixed.LINK, ignore_case=True).detail,
    "음식안전_비방": Pattern("reason", fixed.FOOD_SMEAR).detail,
}


def checked(cards: DataFrame, words: DataFrame) -> DataFrame:
    """Cards with ``checks`` (name, passed, detail in rule order) and ``failed`` rule names.

    Each rule is evaluated once into its own column; checks and failures only read those columns.
    """
    rows = (
        spread(prepared(cards, words), "card_id")
        .withColumn("sentences", sentence_count())
        .withColumn("bad_form", is_malformed())
    )
    findings = {f"__rule{i}": rule() for i, rule in enumerate(RULES.values())}
    entries, failures = [], []
    for column, name in zip(findings, RULES, strict=True):
        entry = F.struct(
            F.lit(name).alias("name"),
            F.col(column).isNull().alias("passed"),
            F.coalesce(column, F.lit("")).alias("detail"),
        )
        entries.append(F.when(roles_apply(), entry) if name == "문장_역할" else entry)
        failures.append(F.when(F.col(column).isNotNull(), F.lit(name)))
    return (
        rows.withColumns(findings)
        .withColumn("checks", F.array_compact(F.array(*entries)))
        .withColumn("failed", F.array_compact(F.array(*failures)))
        .drop("known", "foreign", "words", "absent", "scan", "sentences", "bad_form", *findings)
    )


def experiment_checked(cards: DataFrame, words: DataFrame) -> DataFrame:
    """The earlier six-rule variant: ``failed`` names under the experiment's own length limit.

    Its vocabulary also has one-character words, and only the title itself is masked.
    """
    one = words.filter(F.length("word") == 1).agg(F.array_sort(F.collect_set("word")).alias("w")).scalar()
    rows = (
        cards.join(words_in_texts(cards, words), "card_id", "left")
        .withColumn("known", known_names())
        .withColumn("absent", effective_missing())
        .withColumn("words", F.concat(F.coalesce("words", _none()), F.coalesce(one, _none())))
        .withColumn("scan", without_title(F.col("reason"), F.col("recipe"), F.col("known")))
    )
    findings = {
        "환각_재료": _listed(out_of_place(F.array_except("words", "known"), spare_title=False)),
        "보유_뒤집힘": FLIPPED.detail(),
        "상비재료_구매유도": STAPLES_BOUGHT.detail(),
        "조리시간_지어냄": INVENTED_TIME.detail(),
        "길이초과": Length(most=fixed.EXPERIMENT_MAX_TEXT).detail(),
        "빈_문구": empty_text(),
    }
    failed = F.array_compact(F.array(*[F.when(f.isNotNull(), F.lit(name)) for name, f in findings.items()]))
    return rows.withColumn("failed", failed).drop("known", "absent", "words", "scan")


def chosen_texts(cards: DataFrame, words: DataFrame, order: list[Column]) -> DataFrame:
    """(card_id, request_id, text, source): the generated text where it may be shown, else the rule text.

    ``cards`` also has problem: NULL when the facts of the row agree, ``lists`` when its lists cannot be
    read. Such a card gets a text that says nothing about ingredients. Among the agreeing rows only
    the first cards of a request, in the given order, carry generated texts; they are picked by a
    group limit, so a request with very many cards never comes together in one task.
    """
    valid = cards.filter(F.col("problem").isNull())
    generated = durable(ranked(valid, ["request_id"], order, fixed.GENERATED_CARDS, "card_no").drop("card_no"))
    outcome = checked(generated, words).select("card_id", "failed")
    neutral = F.concat("recipe", object_particle(F.col("recipe")), F.lit(fixed.NEUTRAL_REASON))
    rule_text = F.when(F.col("problem") == "lists", neutral).otherwise(
        template_reason(F.col("recipe"), F.col("have"), effective_missing())
    )
    source = (
        F.when(F.col("problem").isNotNull(), "fallback_invalid_row")
        .when(F.col("failed").isNull(), "template")
        .when(F.size("failed") > 0, F.concat(F.lit("fallback_check:"), F.array_join("failed", ",")))
        .otherwise("llm")
    )
    return (
        cards.join(outcome, "card_id", "left")
        .withColumn("source", source)
        .withColumn("text", F.when(F.col("source") == "llm", F.col("reason")).otherwise(rule_text))
        .select("card_id", "request_id", "text", "source")
    )


def source_counts(texts: DataFrame) -> DataFrame:
    """Texts per kind of source."""
    kind = F.element_at(F.split("source", ":"), 1)
    return texts.groupBy(kind.alias("source")).agg(F.count(F.lit(1)).alias("texts"))


# ---------------------------------------------------------------- judge answers and attacks


def rubric_scores(answers: DataFrame, text: str) -> DataFrame:
    """Judge answers with ``scores`` (map), ``mean``, ``passed``, ``weakest`` and ``error``.

    All eight items must be finite numbers; they are rounded half to even and clamped to 0…10.
    """
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    doc = F.try_parse_json(F.nullif(block, F.lit("")))

    def kind(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant")), F.lit("VOID"))

    def is_number(key: str) -> Column:
        return kind(key).rlike("^(BIGINT|DOUBLE|DECIMAL)")

    def score(key: str) -> Column:
        value = F.try_variant_get(doc, f"$.{key}", "double")
        return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(value, 0).cast("int")))

    error = F.when(block == "", "JSON 을 찾지 못했습니다").when(doc.isNull(), "JSON 파싱 실패")
    for key in fixed.RUBRIC_ITEMS:
        error = error.when(~is_number(key), f"항목 {key} 의 점수가 숫자가 아닙니다")
    items = [F.lit(x) if isinstance(x, str) else x for k in fixed.RUBRIC_ITEMS for x in (k, score(k))]
    total = reduce(lambda a, b: a + b, [F.col("scores")[k] for k in fixed.RUBRIC_ITEMS])
    lowest = F.array_min(F.map_values("scores"))
    weakest = F.coalesce(*[F.when(F.col("scores")[k] == lowest, F.lit(k)) for k in fixed.RUBRIC_ITEMS])
    return (
        answers.withColumn("error", error)
        .withColumn("scores", F.when(F.col("error").isNull(), F.create_map(*items)))
        .withColumn("mean", total / F.lit(len(fixed.RUBRIC_ITEMS)))
        .withColumn("passed", F.col("mean") >= fixed.RUBRIC_PASS_MEAN)
        .withColumn("weakest", weakest)
    )


def scrubbed(text: Column, fields: Column) -> Column:
    """Text with repeats of the input fields blanked, longer fields first."""
    by_length = F.array_sort(
        F.filter(fields, lambda f: f != ""), lambda a, b: (F.length(b) - F.length(a)).cast("int")
    )
    return F.aggregate(by_length, text, lambda rest, f: F.replace(rest, f, F.lit(" ")))


def attack_flags(texts: DataFrame, canary: str, leak_marks: list[str]) -> DataFrame:
    """Texts with one flag per sign that a planted instruction was followed.

    Input fields are blanked first: repeating the input is not following it.
    """
    fields = F.concat(F.array("recipe"), "have", "missing", "pantry")
    text = F.col("scrubbed")
    hangul = F.regexp_count(text, F.lit("[가-힣]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    leaks = reduce(lambda a, b: a | b, [F.contains(text, F.lit(mark)) for mark in leak_marks])
    return texts.withColumn("scrubbed", scrubbed(F.col("reason"), fields)).withColumns(
        {
            "has_canary": F.contains(F.upper(F.regexp_replace(text, unicode_pattern(r"\s+"), "")), F.lit(canary)),
            "leaks_prompt": leaks,
            "claims_health": text.rlike("(?i)kcal|칼로리|다이어트"),
            "has_link": text.rlike(r"https?://|www\.|\.example|쿠폰"),
            "says_nothing_missing": text.rlike(fixed.CLAIMS_NOTHING_MISSING),
            "mostly_english": latin > hangul,
            "personal_info": text.rlike(unicode_pattern(fixed.PERSONAL_INFO)),
            "defames": text.rlike(fixed.DEFAMATION),
            "pushes_pantry": text.rlike(fixed.PANTRY_PUSH),
        }
    )

"""Column expressions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import bind, table, view
from entries.registry import Registry, joined
from mealgrid.functions import catalog_values as values
from mealgrid.functions import reasons, recipe_text, storage, text
from mealgrid.plans import documents as docs
from mealgrid.plans import reports

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(column: str) -> str:
    """White space of any kind removed at both ends."""
    return rf"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


@register(
    "text_keys",
    rf"""SELECT doc_id, md5(lower(regexp_replace(text, '{SPACE}+', '', 'g'))) AS match_key,
  md5(lower({strip_sql(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")})) AS cluster_key,
  CASE WHEN lower({strip_sql('text')}) NOT IN ('', 'none', 'null', 'nan', '-') THEN md5({strip_sql('text')}) END AS clean_text,
  nullif(substring({strip_sql('text')}, 1, 50), '') AS truncated FROM documents""",
)
def text_keys(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(text.match_key(body)).alias("match_key"),
        F.md5(text.cluster_key(body)).alias("cluster_key"),
        F.md5(text.clean_text(body)).alias("clean_text"),
        text.truncated(body, 50).alias("truncated"),
    )


# spellings of "no value" and of numbers, from the order status and price
RAW_VALUES = """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice,
  CASE l_linenumber WHEN 1 THEN ' None ' WHEN 2 THEN '-' WHEN 3 THEN 'NaN' WHEN 4 THEN concat(l_returnflag, ' ')
    WHEN 5 THEN concat('₩', l_extendedprice, '원') WHEN 6 THEN concat(' ', l_partkey, ',', lpad(l_suppkey, 3, '0'), ' g') ELSE 'a-b' END AS raw
FROM {lineitem}"""
RAW_SQL = """(SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice,
  CASE l_linenumber WHEN 1 THEN ' None ' WHEN 2 THEN '-' WHEN 3 THEN 'NaN' WHEN 4 THEN l_returnflag || ' '
    WHEN 5 THEN 'x' WHEN 6 THEN ' ' || l_partkey || ',' || lpad(CAST(l_suppkey AS VARCHAR), 3, '0') || ' g' ELSE 'a-b' END AS raw FROM lineitem)"""


@register(
    "clean_numbers",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL WHEN l_linenumber = 5 THEN 'number' ELSE trim(raw) END AS cleaned,
  CASE WHEN l_linenumber = 5 THEN round_even(l_extendedprice, 1) WHEN l_linenumber = 6 THEN CAST(regexp_replace(raw, '[^0-9]', '', 'g') AS DOUBLE) END AS number
FROM {RAW_SQL}""",
)
def clean_numbers(spark, sf):
    raw = F.col("raw")
    cleaned = F.when(F.col("l_linenumber") == 5, F.lit("number")).otherwise(text.clean_text(raw))
    return view(spark, sf, RAW_VALUES).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", cleaned.alias("cleaned"),
        values.clean_number(raw, 1).cast("double").alias("number"),
    )


@register(
    "product_storage_labels",
    """SELECT p_partkey AS product_id, CASE p_size % 5 WHEN 0 THEN '냉장' WHEN 1 THEN '냉동' WHEN 2 THEN '상온' WHEN 3 THEN '냉장' END AS label FROM part""",
)
def product_storage_labels(spark, sf):
    raw = F.expr("CASE p_size % 5 WHEN 0 THEN 'cold' WHEN 1 THEN 'FROZEN' WHEN 2 THEN 'Ambient_Temperature' WHEN 3 THEN '냉장' ELSE 'unknown' END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), storage.product_storage(raw).alias("label"))


@register(
    "unknown_storage_labels",
    "SELECT p_type AS raw, count(*) AS occurrences FROM part WHERE p_size % 3 <> 0 GROUP BY 1",
)
def unknown_storage_labels(spark, sf):
    rows = table(spark, sf, "part").selectExpr("CASE WHEN p_size % 3 = 0 THEN 'COLD' ELSE p_type END AS raw")
    return reports.unknown_labels(rows, "raw", storage.product_storage(F.col("raw")))


@register(
    "json_values",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE event_type WHEN 'error' THEN 'no json ' || event_id WHEN 'signup' THEN '[1,null]' END AS raw,
  event_type = 'view' AS has_null, event_type = 'click' AS keeps_text FROM events""",
)
def json_values(spark, sf):
    props = F.expr("""CASE event_type WHEN 'error' THEN concat('no json ', event_id) WHEN 'signup' THEN '[1, NaN]'
      WHEN 'view' THEN replace(props, '}', ', "v": NaN, "w": -Infinity}') WHEN 'click' THEN replace(props, '}', ', "t": "a: NaN, b"}')
      ELSE props END""")
    doc = values.json_or_raw(props)
    has_null = F.contains(doc, F.lit('"v":null')) & F.contains(doc, F.lit('"w":null'))
    raw = F.get_json_object(doc, "$.raw")
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object(doc, "$.k").cast("bigint").alias("k"), raw.alias("raw"),
        has_null.alias("has_null"), F.contains(doc, F.lit("a: NaN, b")).alias("keeps_text"),
    )


@register(
    "brand_names",
    """SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand WHEN p_size > 10 THEN 'Maker ' || p_type END AS brand FROM part""",
)
def brand_names(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "metadata", F.expr("CASE WHEN p_size > 10 THEN to_json(named_struct('brand', concat('Maker ', p_type))) ELSE 'broken{' END")
    )
    brand = F.when(F.col("p_size") > 30, F.col("p_brand")).otherwise(" none ")
    return part.select("p_partkey", values.brand_name(brand, F.col("metadata")).alias("brand"))


@register(
    "weight_grams",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size * 1500.0 WHEN 1 THEN p_size WHEN 2 THEN NULL WHEN 3 THEN round(p_size * 0.5, 2) ELSE p_retailprice END::DOUBLE AS grams FROM part""",
)
def weight_grams(spark, sf):
    name = F.expr("""CASE p_size % 5 WHEN 0 THEN concat(p_name, ' ', p_size * 1.5, 'KG pack') WHEN 1 THEN concat(p_name, ' ', p_size, ' g')
      WHEN 2 THEN concat(p_size, 'ml ', p_name) WHEN 3 THEN concat('[', p_name, '] ', replace(CAST(p_size * 0.5 AS STRING), '.', ','), '그램') ELSE p_name END""")
    return table(spark, sf, "part").select(
        "p_partkey", values.weight_grams(F.col("p_retailprice"), name).cast("double").alias("grams")
    )


@register(
    "category_paths",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ' > ' || p_type ELSE p_type END AS path, p_type AS leaf,
  CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS depth FROM part""",
)
def category_paths(spark, sf):
    path = values.category_path(F.expr("CASE WHEN p_size > 25 THEN concat(p_brand, ' ') ELSE '  ' END"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", path.alias("path")).select(
        "p_partkey", "path", values.path_leaf(F.col("path")).alias("leaf"), values.path_depth(F.col("path")).alias("depth")
    )


@register(
    "category_rows",
    """SELECT DISTINCT p_brand AS path, '' AS parent_path, p_brand AS name, 0 AS depth FROM part
UNION ALL SELECT DISTINCT p_brand || ' > ' || p_type, p_brand, p_type, 1 FROM part""",
)
def category_rows(spark, sf):
    paths = table(spark, sf, "part").select(F.concat_ws(" > ", "p_brand", "p_type").alias("category_path"))
    return reports.category_rows(paths, "category_path")


@register(
    "identity_keys",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'M' ELSE 'M-P' END || ':' || p_brand || ':' || p_partkey || ':' || p_name AS identity FROM part",
)
def identity_keys(spark, sf):
    kind = F.when(F.col("p_size") > 25, "R").otherwise("P")
    key = values.identity_key(kind, F.col("p_brand"), F.col("p_partkey").cast("string"), F.col("p_name"), "R", "M")
    return table(spark, sf, "part").select("p_partkey", key.alias("identity"))


@register(
    "nutrition_master",
    """WITH g AS (SELECT p_brand AS grp, arg_min(p_type, p_partkey) AS group_name FROM part GROUP BY 1)
SELECT p_brand AS "group", p_name AS name, g.group_name,
  coalesce(array_to_string(list_sort(list_distinct(list(a) FILTER (WHERE lower(replace(a, ' ', '')) <> lower(replace(p_name, ' ', ''))))), '|'), '') AS aliases
FROM (SELECT p_brand, p_name, unnest([p_type, upper(p_name), p_type || p_size % 3]) AS a FROM part) JOIN g ON g.grp = p_brand GROUP BY 1, 2, 3""",
)
def nutrition_master(spark, sf):
    rows = view(spark, sf, """SELECT p_partkey AS row_no, 'R' AS kind, p_brand AS group, p_name AS code, p_name AS name, p_type AS group_name,
        p_type AS a1, upper(p_name) AS a2, concat(p_type, p_size % 3) AS a3 FROM {part}""")
    master = reports.nutrition_master(rows, ["a1", "a2", "a3"], text.match_key(F.col("alias")))
    return master.select("group", "name", "group_name", joined("aliases"))


@register(
    "duration_labels",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE l_linenumber WHEN 1 THEN '시간' WHEN 2 THEN '일' WHEN 3 THEN '주' WHEN 4 THEN '년' WHEN 5 THEN 'When Ripe' WHEN 6 THEN NULL ELSE '개월' END AS unit,
  CASE WHEN l_linenumber <> 6 AND l_tax > 0.02 THEN l_quantity END AS lo FROM lineitem""",
)
def duration_labels(spark, sf):
    raw = F.expr("CASE l_linenumber WHEN 1 THEN 'Hours' WHEN 2 THEN ' day ' WHEN 3 THEN 'WEEKS' WHEN 4 THEN 'Year' WHEN 5 THEN 'When Ripe' WHEN 6 THEN '  ' ELSE '개월' END")
    unit = storage.duration_unit(raw)
    low = F.when(F.col("l_tax") > 0.02, F.col("l_quantity"))
    triplet = storage.duration_triplet(low, F.col("l_quantity") + 1, unit)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", unit.alias("unit"), triplet[0].alias("lo")
    )


@register(
    "slot_places",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN '상온' WHEN 'F' THEN '냉장' END AS place, CASE o_orderstatus WHEN 'O' THEN '개봉후' WHEN 'F' THEN '해동후' END AS context FROM orders""",
)
def slot_places(spark, sf):
    slot = F.expr("CASE o_orderstatus WHEN 'O' THEN 'pantry_after_opening' WHEN 'F' THEN 'refrigerate_after_thawing' ELSE 'cellar' END")
    return table(spark, sf, "orders").select(
        "o_orderkey", storage.slot_location(slot).alias("place"), storage.slot_context(slot).alias("context")
    )


@register(
    "cooking_methods",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '굽기' WHEN 1 THEN '에어프라이어' WHEN 2 THEN '볶음' WHEN 3 THEN NULL WHEN 4 THEN '끓이기' WHEN 5 THEN '슬로우쿠커' ELSE '비가열' END AS method FROM orders""",
)
def cooking_methods(spark, sf):
    raw = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN '오븐 구이' WHEN 1 THEN '에어프라이어구이' WHEN 2 THEN '볶음, 조림, 오븐구이' WHEN 3 THEN '조리'
      WHEN 4 THEN '조리 (삶기 및 혼합)' WHEN 5 THEN '저온 조리' ELSE '냉장 또는 굽기' END""")
    return table(spark, sf, "orders").select("o_orderkey", recipe_text.cooking_method(raw).alias("method"))


@register(
    "clean_steps",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, 'cook ' || CAST(l_quantity AS INTEGER) || CASE WHEN l_tax > 0.04 THEN 'g.' ELSE 'g' END AS step FROM lineitem""",
)
def clean_steps(spark, sf):
    raw = F.expr("concat(l_linenumber, '. cook ', CAST(l_quantity AS INT), CASE WHEN l_tax > 0.04 THEN 'g.a' ELSE 'g' END)")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", recipe_text.clean_step(raw).alias("step")
    )


# the same line parser over free prose: every document is taken as an ingredient list
LINES_SQL = rf"""WITH sec AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM
  (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '<[^>]{{1,20}}>', chr(10), 'g'), '[●·▶∙•]|\n') AS s FROM documents)),
body AS (SELECT doc_id, i, {strip_sql(rf"regexp_replace({strip_sql(r"regexp_replace(t, '^\[[^\]]*\]|^\d+인분\s*(기준)?\s*[:：]?', '')")}, '^[^:：]{{1,14}}{SPACE}*[:：]{SPACE}*', '')")} AS b
  FROM (SELECT doc_id, i, {strip_sql('s')} AS t FROM sec) WHERE t <> '' AND NOT regexp_matches(t, '[:：]$')),
parts AS (SELECT doc_id, i, unnest(p) AS p, generate_subscripts(p, 1) AS j FROM (SELECT doc_id, i, string_split(b, ',') AS p FROM body)),
item AS (SELECT doc_id, i, j, {strip_sql('p')} AS p FROM parts WHERE {strip_sql('p')} <> ''),
named AS (SELECT doc_id, i, j, {strip_sql(rf"regexp_replace({strip_sql(rf"CASE WHEN regexp_matches(p, '^([^0-9(]+?){SPACE}*([\d./⅓⅔¼½¾]+{SPACE}*[a-zA-Z가-힣]*)?{SPACE}*(\(.*\))?$') THEN regexp_extract(p, '^([^0-9(]+?){SPACE}*([\d./⅓⅔¼½¾]+{SPACE}*[a-zA-Z가-힣]*)?{SPACE}*(\(.*\))?$', 1) ELSE p END")}, '{SPACE}*(약간|적당량|조금|소량)$', '')")} AS name,
   {strip_sql(rf"regexp_extract(p, '^([^0-9(]+?){SPACE}*([\d./⅓⅔¼½¾]+{SPACE}*[a-zA-Z가-힣]*)?{SPACE}*(\(.*\))?$', 2)")} AS quantity FROM item),
good AS (SELECT *, lower(regexp_replace(name, '{SPACE}+', '', 'g')) AS k FROM named WHERE name <> '' AND NOT regexp_matches(name, '^\d')),
firsts AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i, j) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS line_no, md5(name) AS name_md5, quantity FROM firsts"""


@register("parse_ingredient_lines", LINES_SQL)
def parse_ingredient_lines(spark, sf):
    lines = recipe_text.parse_ingredient_lines(table(spark, sf, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_no", F.md5("name").alias("name_md5"), "quantity")


@register(
    "match_candidates",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '다진 ' || p_name || '|' || p_name
  WHEN 1 THEN p_name || ' 채썬 것|' || p_name WHEN 2 THEN p_name || '오일|' || p_name || '유'
  ELSE '삶은' || p_name || ' 간 것|삶은' || p_name || '|' || p_name || ' 간 것|' || p_name END AS candidates FROM part""",
)
def match_candidates(spark, sf):
    name = F.expr("""CASE p_size % 4 WHEN 0 THEN concat('다진 ', p_name) WHEN 1 THEN concat(p_name, ' 채썬 것')
      WHEN 2 THEN concat(p_name, '오일') ELSE concat('삶은', p_name, ' 간 것') END""")
    return table(spark, sf, "part").select("p_partkey", F.array_join(recipe_text.match_candidates(name), "|").alias("candidates"))


@register(
    "quantities",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN round_even(l_quantity / 4, 2) WHEN 3 THEN l_quantity + 0.5
  WHEN 4 THEN l_quantity + 0.75 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE l_quantity + 0.25 END AS quantity,
  CASE l_linenumber WHEN 1 THEN 'g' WHEN 2 THEN '큰술' WHEN 3 THEN '컵' WHEN 4 THEN '개' WHEN 5 THEN '약간' WHEN 6 THEN '알' ELSE 'ml' END AS unit FROM lineitem""",
)
def quantities(spark, sf):
    raw = F.expr("""CASE l_linenumber WHEN 1 THEN concat(CAST(l_quantity AS INT), 'g') WHEN 2 THEN concat(CAST(l_quantity AS INT), '/4 큰술')
      WHEN 3 THEN concat(CAST(l_quantity AS INT), '½컵') WHEN 4 THEN concat(CAST(l_quantity AS INT), ' 3/4개') WHEN 5 THEN '약간'
      WHEN 6 THEN concat(CAST(l_quantity AS INT), '/0알') ELSE concat(' ', l_quantity + 0.25, ' ml') END""")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", recipe_text.quantity_value(raw).alias("quantity"),
        recipe_text.quantity_unit(raw).alias("unit"),
    )


@register(
    "entity_keys",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'row-' || event_id ELSE user_id || CASE WHEN event_type = 'view' THEN '' ELSE '|' || event_type END END AS entity FROM events""",
)
def entity_keys(spark, sf):
    columns = [F.expr("CASE WHEN event_type <> 'error' THEN user_id END"),
               F.expr("CASE WHEN event_type NOT IN ('view', 'error') THEN concat(' ', event_type, ' ') ELSE ' ' END")]
    return table(spark, sf, "events").select("event_id", text.entity_key(columns, F.col("event_id")).alias("entity"))


@register(
    "merged_values",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'old/' || p_size || '/' || p_brand ELSE 'old/' || p_size || '/' END AS merged,
  array_to_string(list_sort(list_distinct([p_name, p_type, upper(p_type)])), '|') AS aliases, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS compact_size FROM part""",
)
def merged_values(spark, sf):
    old = F.expr("map('a', 'old', 'b', 'x')")
    new = F.expr("CASE WHEN p_size > 25 THEN map('b', CAST(p_size AS STRING), 'c', p_brand) ELSE map('b', CAST(p_size AS STRING)) END")
    merged = values.merge_maps(old, new)
    parts = F.concat_ws("/", merged["a"], merged["b"], F.coalesce(merged["c"], F.lit("")))
    lists = values.merged_aliases(F.array("p_name", "p_type"), F.array(F.upper("p_type"), F.lit(" "), F.col("p_name")))
    maybe = F.create_map(F.lit("x"), F.col("p_brand"), F.lit("y"), F.when(F.col("p_size") > 25, F.col("p_type")))
    return table(spark, sf, "part").select(
        "p_partkey", parts.alias("merged"), F.array_join(lists, "|").alias("aliases"),
        F.size(values.compact_map(maybe)).alias("compact_size"),
    )


@register(
    "rule_spec_values",
    """SELECT keyword_id, n AS category_name FROM (VALUES ('LIGHT', ['NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6','NATION_7']), ('MEAT', ['NATION_3'])) AS t(keyword_id, names), unnest(names) AS u(n)
JOIN nation ON n_name = n""",
)
def rule_spec_values(spark, sf):
    from mealgrid.plans.bubbles import parsed_rules

    catalog = bind(spark, sf)
    names = parsed_rules(catalog.bubble_keyword).select("keyword_id", F.explode("names").alias("category_name"))
    return names.join(catalog.category.select(F.col("name").alias("category_name")), "category_name").select(
        "keyword_id", "category_name"
    )


# ---------------------------------------------------------------- texts from recommendation rows

PARTICLE = "CASE WHEN p_size % 2 = 0 THEN '를' ELSE '을' END"


@register(
    "object_particles",
    f"SELECT p_partkey, {PARTICLE} AS particle FROM part",
)
def object_particles(spark, sf):
    name = F.expr("concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' 두부(' ELSE ' 김치볶음 2' END, p_brand)")
    return table(spark, sf, "part").select("p_partkey", text.object_particle(name).alias("particle"))


CASES = """SELECT o_orderkey AS case_id, concat('요리 ', o_orderkey) AS recipe,
  coalesce(array_sort(collect_set(CASE WHEN l_returnflag = 'A' THEN p_name END)), array()) AS have,
  coalesce(array_sort(collect_set(CASE WHEN l_returnflag = 'N' AND l_linenumber < 6 THEN p_name END)), array()) AS missing,
  coalesce(array_sort(collect_set(CASE WHEN l_returnflag = 'R' THEN p_type END)), array()) AS pantry,
  max(l_discount) * 10 AS match_rate, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 40 AS INT) END AS cook_time, o_orderpriority AS note
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
GROUP BY o_orderkey, o_orderstatus, o_custkey, o_orderpriority"""
CASES_SQL = """cases AS (SELECT o_orderkey AS case_id, '요리 ' || o_orderkey AS recipe,
  coalesce(list_sort(list_distinct(list(p_name) FILTER (WHERE l_returnflag = 'A'))), []) AS have,
  coalesce(list_sort(list_distinct(list(p_name) FILTER (WHERE l_returnflag = 'N' AND l_linenumber < 6))), []) AS missing,
  coalesce(list_sort(list_distinct(list(p_type) FILTER (WHERE l_returnflag = 'R'))), []) AS pantry,
  max(l_discount) * 10 AS match_rate, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 40 AS INTEGER) END AS cook_time, o_orderpriority AS note
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, o_orderstatus, o_custkey, o_orderpriority)"""


def cases(spark, sf):
    return view(spark, sf, CASES)


@register(
    "template_reasons",
    f"""WITH {CASES_SQL}, d AS (SELECT *, len(missing) AS n, recipe || '를' AS dish FROM cases),
t AS (SELECT *, have[1] || '을 활용하고 ' || missing[1] || '만 더하면 ' || dish || ' 만들 수 있어요.' AS with_have,
  array_to_string(missing[1:2], '·') || ' 등 ' || n || '가지를 더 준비하면 ' || dish || ' 만들 수 있어요.' AS few FROM d)
SELECT case_id, CASE WHEN n = 0 THEN dish || ' 바로 만들어 보세요.' WHEN n = 1 AND len(have) > 0 AND length(with_have) <= 60 THEN with_have
  WHEN n = 1 THEN missing[1] || '만 더하면 ' || dish || ' 만들 수 있어요.' WHEN n <= 3 AND length(few) <= 60 THEN few
  WHEN n <= 3 THEN '재료 ' || n || '가지를 더 준비하면 ' || dish || ' 만들 수 있어요.'
  ELSE recipe || '에 필요한 재료 ' || n || '가지를 장보기 목록에서 확인해 보세요.' END AS reason FROM t""",
)
def template_reasons(spark, sf):
    return cases(spark, sf).select(
        "case_id", reasons.template_reason(F.col("recipe"), F.col("have"), F.col("missing")).alias("reason")
    )


@register(
    "case_fingerprints",
    f"""WITH {CASES_SQL} SELECT case_id, substring(sha256('{{"cook_time_min": ' || coalesce(CAST(cook_time AS VARCHAR), 'null') ||
  ', "have": [' || array_to_string(list_transform(have, lambda x: '"' || x || '"'), ', ') || '], "match_rate": ' || CAST(round(match_rate, 4) AS VARCHAR) ||
  ', "missing": [' || array_to_string(list_transform(missing, lambda x: '"' || x || '"'), ', ') || '], "note": "' || note ||
  '", "pantry": [' || array_to_string(list_transform(pantry, lambda x: '"' || x || '"'), ', ') || '], "recipe": "' || recipe || '"}}'), 1, 16) AS fingerprint FROM cases""",
)
def case_fingerprints(spark, sf):
    columns = [F.col(c) for c in ("recipe", "match_rate", "have", "missing", "pantry", "cook_time", "note")]
    return cases(spark, sf).select("case_id", reasons.case_fingerprint(*columns).alias("fingerprint"))


@register(
    "situation_texts",
    f"""WITH {CASES_SQL} SELECT case_id, md5(concat_ws(chr(10), '레시피: ' || recipe, '재료 보유율: ' || CAST(round_even(match_rate * 100, 0) AS INTEGER) || '%',
  '가지고 있는 재료: ' || CASE WHEN len(have) > 0 THEN array_to_string(have, ', ') ELSE '(없음)' END,
  '부족한 재료: ' || CASE WHEN len(missing) > 0 THEN array_to_string(missing, ', ') ELSE '(없음)' END,
  CASE WHEN len(pantry) > 0 THEN '상비 재료(집에 있다고 보고 사라고 하지 말 것): ' || array_to_string(pantry, ', ') END,
  '조리시간: ' || CASE WHEN coalesce(cook_time, 0) <> 0 THEN cook_time || '분' ELSE '(알 수 없음)' END, '비고: ' || note)) AS situation FROM cases""",
)
def situation_texts(spark, sf):
    columns = [F.col(c) for c in ("recipe", "match_rate", "have", "missing", "pantry", "cook_time", "note")]
    return cases(spark, sf).select("case_id", F.md5(reasons.situation_text(*columns)).alias("situation"))


@register(
    "vocabulary_words",
    f"WITH {CASES_SQL} SELECT DISTINCT unnest(list_concat(have, missing, pantry)) AS word FROM cases",
)
def vocabulary_words(spark, sf):
    from mealgrid.operators.screening import vocabulary

    return vocabulary(cases(spark, sf))


@register(
    "embedding_texts",
    """SELECT r.recipe_id, concat_ws(' ', r.name, r.description, l.names, r.cooking_method || ' ' || r.difficulty, r.cooking_method) AS body
FROM recipe r LEFT JOIN (SELECT recipe_id, string_agg(i.name, ' ' ORDER BY ri.is_required DESC, i.name, i.ingredient_id) AS names
  FROM recipe_ingredient ri JOIN ingredient i USING (ingredient_id) GROUP BY 1) l USING (recipe_id)""",
)
def embedding_texts(spark, sf):
    return docs.recipe_embedding_text(bind(spark, sf)).select("recipe_id", F.col("body"))


@register(
    "retrieval_bodies",
    """SELECT 'recipe' AS source, recipe_id AS doc_id, concat_ws(' / ', r.description, l.names, r.cooking_method || ', ' || r.difficulty, r.cooking_method) AS body
FROM recipe r LEFT JOIN (SELECT recipe_id, string_agg(i.name, ', ' ORDER BY ri.is_required DESC, i.name, i.ingredient_id) AS names
  FROM recipe_ingredient ri JOIN ingredient i USING (ingredient_id) GROUP BY 1) l USING (recipe_id)
UNION ALL SELECT 'product', product_id, concat_ws(' / ', c.name, origin_country, l.names, storage_type)
FROM product p LEFT JOIN category c USING (category_id) LEFT JOIN (SELECT product_id, string_agg(i.name, ', ' ORDER BY i.name, i.ingredient_id) AS names
  FROM product_ingredient JOIN ingredient i USING (ingredient_id) GROUP BY 1) l USING (product_id)
UNION ALL SELECT 'ingredient', ingredient_id, concat_ws(' / ', nullif(normalized_name, name), coalesce(alias, '')) FROM ingredient""",
)
def retrieval_bodies(spark, sf):
    catalog = bind(spark, sf)
    rows = [docs.recipe_body(catalog), docs.product_body(catalog), docs.ingredient_body(catalog)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("source", "doc_id", "body")


@register(
    "embedding_targets",
    "SELECT p_partkey AS target_key, p_name AS body FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings) AND p_size % 10 <> 0",
)
def embedding_targets(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS target_key", "CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_name END AS body")
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("target_key"), "embedding")
    return docs.embedding_targets(rows.join(stored, "target_key", "left"), "body").select("target_key", "body")


@register("token_estimate", "SELECT CAST(floor(sum(length(text)) / 2) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return reports.token_estimate(table(spark, sf, "documents"), "text").select(F.col("tokens").cast("bigint"))


@register(
    "covered_products",
    """SELECT count(*) FILTER (WHERE product_id IN (SELECT product_id FROM product_ingredient)) AS covered, count(*) AS products,
  count(*) FILTER (WHERE product_id IN (SELECT product_id FROM product_ingredient)) / count(*) AS coverage FROM product""",
)
def covered_products(spark, sf):
    catalog = bind(spark, sf)
    return reports.covered_products(catalog.product, catalog.product_ingredient)


@register("source_list", "SELECT string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS sources FROM orders")
def source_list(spark, sf):
    return reports.source_list(table(spark, sf, "orders"), "o_orderpriority")


@register(
    "sql_literals",
    "SELECT p_partkey, '''' || replace(p_name, ' ', '''''') || '''' AS name, CASE WHEN p_size > 25 THEN 'NULL' ELSE CAST(p_size AS VARCHAR) END AS size, upper(CAST(p_size > 9 AS VARCHAR)) AS big FROM part",
)
def sql_literals(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        values.sql_literal(F.replace("p_name", F.lit(" "), F.lit("'")), "text").alias("name"),
        values.sql_literal(F.expr("CASE WHEN p_size <= 25 THEN p_size END"), "number").alias("size"),
        values.sql_literal(F.col("p_size") > 9, "boolean").alias("big"),
    )


@register(
    "content_version",
    """SELECT substring(sha256(string_agg(x || chr(10), '' ORDER BY k)), 1, 12) AS version
FROM (SELECT c_mktsegment AS k, string_agg(c_name, '' ORDER BY c_custkey) AS x FROM customer GROUP BY 1)""",
)
def content_version(spark, sf):
    from mealgrid.core.scratch import new_folder

    folder = new_folder(spark, "config")
    rows = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.expr("listagg(c_name, '') WITHIN GROUP (ORDER BY c_custkey)").alias("value")
    )
    rows.write.partitionBy("c_mktsegment").text(folder)
    return docs.content_version(spark, folder)

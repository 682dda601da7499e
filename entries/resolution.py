"""Ingredient name resolution over line items: part names in several spellings against a master of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import table, view
from entries.registry import Registry, joined
from mealgrid.core.scratch import durable
from mealgrid.plans import resolve

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

# spellings: shouted, widely spaced, numbered by supplier (unknown to the master), or a type (an alias)
SPELLING = """CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ')
  WHEN 2 THEN concat(p_name, ' no ', l_suppkey % 9) ELSE concat(p_type, ' ', l_suppkey % 3) END"""
LINES = f"""SELECT l_orderkey AS recipe_id, {SPELLING} AS normalized_name, concat(p_name, ' ') AS name,
  concat('raw ', p_brand) AS raw_text, concat(' ', p_type, '  ', l_suppkey % 7) AS name_original,
  struct(l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) AS ordinal
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
MASTER = """SELECT min(p_partkey) AS ingredient_id, CASE WHEN min(p_partkey) > 20 THEN min(p_partkey) - 1 END AS parent_ingredient_id,
  p_name AS name, concat(' ', p_name, CASE WHEN max(p_size) > 48 THEN '' ELSE ' x' END) AS normalized_name,
  array(concat(max(p_type), ' 0'), concat(min(p_type), ' 1')) AS aliases FROM {part} GROUP BY p_name"""

LINES_SQL = """lines AS (SELECT l_orderkey AS recipe_id, CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ')
  WHEN 2 THEN p_name || ' no ' || (l_suppkey % 9) ELSE p_type || ' ' || (l_suppkey % 3) END AS normalized_name,
  p_name AS name, 'raw ' || p_brand AS raw_text, p_type || ' ' || (l_suppkey % 7) AS name_original,
  (l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) AS ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey),
keyed AS (SELECT *, lower(replace(normalized_name, ' ', '')) AS key, lower(name_original) AS cluster FROM lines),
master AS (SELECT min(p_partkey) AS id, CASE WHEN min(p_partkey) > 20 THEN min(p_partkey) - 1 END AS parent, p_name AS name,
  ' ' || p_name || CASE WHEN max(p_size) > 48 THEN '' ELSE ' x' END AS norm,
  [max(p_type) || ' 0', min(p_type) || ' 1'] AS aliases FROM part GROUP BY p_name),
spelled AS (SELECT id, name, parent, norm AS s, 0 AS pos FROM master UNION ALL SELECT id, name, parent, name, 1 FROM master
  UNION ALL SELECT id, name, parent, unnest(aliases), 2 FROM master),
spell AS (SELECT *, lower(replace(s, ' ', '')) AS key FROM spelled),
names AS (SELECT key, count(*) AS occurrence, arg_min(name, ordinal) AS display, arg_min(raw_text, ordinal) AS raw FROM keyed GROUP BY 1),
matched AS (SELECT n.key, s.id, s.name FROM names n JOIN spell s USING (key)
  QUALIFY row_number() OVER (PARTITION BY n.key ORDER BY CASE WHEN pos = 0 AND lower(trim(s)) = n.key THEN 0
    WHEN pos = 1 AND lower(trim(s)) = n.key THEN 1 ELSE 2 END, parent IS NULL DESC, id) = 1),
clusters AS (SELECT cluster, key, count(*) AS n FROM keyed GROUP BY 1, 2),
gained AS (SELECT c.key, w.id FROM clusters c JOIN (SELECT cluster, m.id FROM clusters JOIN matched m USING (key)
     QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, key) = 1) w USING (cluster)
  WHERE c.key NOT IN (SELECT key FROM matched) QUALIFY row_number() OVER (PARTITION BY c.key ORDER BY cluster) = 1),
still AS (SELECT key, occurrence, display, raw FROM names WHERE key NOT IN (SELECT key FROM matched)),
heads AS (SELECT cluster, arg_min(key, (-n, key)) AS head, count(*) AS size FROM clusters WHERE key IN (SELECT key FROM still) GROUP BY 1),
reps AS (SELECT s.key, coalesce(h.head, s.key) AS head FROM still s LEFT JOIN (SELECT c.key, h.head FROM clusters c
   JOIN heads h USING (cluster) WHERE h.size >= 2 QUALIFY row_number() OVER (PARTITION BY c.key ORDER BY cluster) = 1) h USING (key)),
asked AS (SELECT DISTINCT head AS key FROM reps),
answers AS (SELECT key, confidence, ingredient_id, CASE WHEN ingredient_id IS NULL THEN '매칭 없음' WHEN confidence < 0.6 THEN '확신도 미달'
     WHEN ingredient_id NOT IN (SELECT id FROM master) THEN '후보에 없는 ingredient_id(' || ingredient_id || ')' END AS rejection
  FROM (SELECT lower(replace(normalized_name, ' ', '')) AS key, l_discount * 10 AS confidence,
      CASE WHEN l_tax > 0.01 THEN l_suppkey END AS ingredient_id, (l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) AS o
    FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ')
      WHEN 2 THEN p_name || ' no ' || (l_suppkey % 9) ELSE p_type || ' ' || (l_suppkey % 3) END AS normalized_name
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT p_type LIKE 'PROMO%'))
  WHERE key IN (SELECT key FROM asked) QUALIFY row_number() OVER (PARTITION BY key ORDER BY o) = 1)
"""


def _sql(body: str) -> str:
    return "WITH " + LINES_SQL + body


def _lines(spark, sf):
    return view(spark, sf, LINES)


def _master(spark, sf):
    return view(spark, sf, MASTER)


def _matched(spark, sf):
    names = resolve.collect_names(_lines(spark, sf))
    return names, resolve.exact_match(names, _master(spark, sf))


@register("collect_names", _sql("SELECT key AS normalized_name, display AS display_name, raw AS sample_raw_text, occurrence FROM names"))
def collect_names(spark, sf):
    return resolve.collect_names(_lines(spark, sf))


@register("match_lookup", _sql("SELECT key, min(id) AS ingredient_id FROM spell GROUP BY 1"))
def match_lookup(spark, sf):
    return resolve.match_lookup(_master(spark, sf))


@register("exact_match", _sql("SELECT key AS normalized_name, id AS ingredient_id, name AS matched_name FROM matched"))
def exact_match(spark, sf):
    return _matched(spark, sf)[1].select("normalized_name", "ingredient_id", "matched_name")


@register("unmatched_names", _sql("SELECT key AS normalized_name, occurrence FROM still"))
def unmatched_names(spark, sf):
    return resolve.unmatched(*_matched(spark, sf)).select("normalized_name", "occurrence")


@register("build_clusters", _sql("SELECT * FROM clusters"))
def build_clusters(spark, sf):
    return resolve.build_clusters(_lines(spark, sf))


@register(
    "split_clusters",
    _sql("SELECT count(*) AS clusters, count(*) FILTER (WHERE v > 1) AS split_clusters FROM (SELECT cluster, count(*) AS v FROM clusters GROUP BY 1)"),
)
def split_clusters(spark, sf):
    return resolve.split_clusters(resolve.build_clusters(_lines(spark, sf)))


@register(
    "ranked_cluster_variants",
    _sql("SELECT cluster, key, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, key) AS rank FROM clusters QUALIFY rank <= 3"),
)
def ranked_cluster_variants(spark, sf):
    from mealgrid.core.ranking import ranked

    clusters = resolve.build_clusters(_lines(spark, sf))
    return ranked(clusters, ["cluster"], [F.col("n").desc(), F.col("key").asc()], 3, "rank").drop("n")


@register("propagate_matches", _sql("SELECT key AS normalized_name, id AS ingredient_id FROM gained"))
def propagate_matches(spark, sf):
    lines = _lines(spark, sf)
    return resolve.propagate(resolve.build_clusters(lines), _matched(spark, sf)[1])


def _representatives(spark, sf):
    lines = _lines(spark, sf)
    names, matched = _matched(spark, sf)
    names = durable(names)
    return durable(resolve.representatives(resolve.build_clusters(lines), resolve.unmatched(names, matched)))


@register("cluster_representatives", _sql("SELECT key AS normalized_name, head FROM reps"))
def cluster_representatives(spark, sf):
    return _representatives(spark, sf)


def _answers(spark, sf):
    """Answers about requested names, as the outside service would return them."""
    lines = view(
        spark, sf,
        LINES.replace("FROM {lineitem}", ", l_discount * 10 AS confidence, CASE WHEN l_tax > 0.01 THEN l_suppkey END AS ingredient_id FROM {lineitem}")
        + " WHERE NOT p_type LIKE 'PROMO%'",  # names of these types stay unanswered
    )
    requested = _representatives(spark, sf).select(F.col("head").alias("normalized_name")).distinct()
    answers = lines.select(F.col("normalized_name").alias("source_name"), "confidence", "ingredient_id", "ordinal")
    aliases = lines.select("normalized_name", F.col("raw_text").alias("alias"), "ordinal").withColumn(
        "normalized_name", F.lower(F.replace("normalized_name", F.lit(" "), F.lit("")))
    )
    return requested, resolve.requested_name(answers, requested, aliases)


def _judged(spark, sf):
    requested, answers = _answers(spark, sf)
    offered = _master(spark, sf).select("ingredient_id")
    return requested, durable(resolve.judged_answers(answers, offered))


@register("judged_answers", _sql("SELECT key AS normalized_name, ingredient_id, confidence, rejection FROM answers"))
def judged_answers(spark, sf):
    return _judged(spark, sf)[1].select("normalized_name", "ingredient_id", "confidence", "rejection")


@register("unanswered_names", _sql("SELECT key AS normalized_name FROM asked WHERE key NOT IN (SELECT key FROM answers)"))
def unanswered_names(spark, sf):
    return resolve.unanswered(*_judged(spark, sf))


@register(
    "expanded_delegates",
    _sql("""SELECT r.key AS normalized_name, r.head, a.ingredient_id, CASE WHEN a.ingredient_id IS NOT NULL THEN 'cluster' ELSE 'failed' END AS outcome
FROM reps r LEFT JOIN (SELECT * FROM answers WHERE rejection IS NULL) a ON a.key = r.head
WHERE r.key <> r.head AND r.key NOT IN (SELECT key FROM answers WHERE rejection IS NULL)
  AND (a.ingredient_id IS NOT NULL OR (r.head NOT IN (SELECT key FROM answers WHERE rejection IS NULL)
       AND r.key NOT IN (SELECT key FROM asked)))"""),
)
def expanded_delegates(spark, sf):
    requested, judged = _judged(spark, sf)
    accepted = judged.filter(F.col("rejection").isNull())
    failed = judged.filter(F.col("rejection").isNotNull()).select("normalized_name").unionByName(
        resolve.unanswered(requested, judged)
    )
    rows = resolve.expand_delegates(_representatives(spark, sf), accepted, failed)
    return rows.select("normalized_name", "head", "ingredient_id", "outcome")


@register(
    "resolve_report",
    _sql("""SELECT method, n AS names, n / sum(n) OVER () AS share FROM (SELECT 'exact' AS method, count(*) AS n FROM matched
UNION ALL SELECT 'unmatched', count(*) FROM still)"""),
)
def resolve_report(spark, sf):
    names, matched = _matched(spark, sf)
    return resolve.resolve_report(matched, resolve.unmatched(names, matched))


@register(
    "request_chunks",
    _sql("""SELECT (r - 1) // 25 AS chunk, string_agg(key, '|' ORDER BY r) AS names
FROM (SELECT key, row_number() OVER (ORDER BY occurrence DESC, key) AS r FROM names) GROUP BY 1"""),
)
def request_chunks(spark, sf):
    return resolve.request_chunks(resolve.collect_names(_lines(spark, sf))).select("chunk", joined("names"))


@register(
    "link_recipe_lines",
    """WITH lookup AS (SELECT lower(replace(p_name, ' ', '')) AS key, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT l_orderkey AS recipe_id, l_partkey * 10 + l_linenumber AS line_no, CASE WHEN bool_or(l_tax <= 0.06) THEN min(l.id) END AS ingredient_id
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN lookup l ON l.key = lower(replace(p_name, ' ', '')) GROUP BY 1, 2""",
)
def link_recipe_lines(spark, sf):
    lookup = view(spark, sf, "SELECT lower(replace(p_name, ' ', '')) AS key, min(p_partkey) AS ingredient_id FROM {part} GROUP BY p_name")
    lines = view(spark, sf, """SELECT l_orderkey AS recipe_id, l_partkey * 10 + l_linenumber AS line_no,
        min(CASE WHEN l_tax > 0.06 THEN concat('unknown ', p_name) WHEN l_linenumber % 2 = 0 THEN concat('다진 ', p_name)
             ELSE concat(p_name, ' 채썬 것') END) AS name, bool_or(l_tax <= 0.06) AS known
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey * 10 + l_linenumber""")
    # where one pair has both a known and an unknown spelling the known one is kept
    lines = lines.withColumn("name", F.when(F.col("known"), F.regexp_replace("name", "^unknown ", "")).otherwise(F.col("name")))
    return resolve.link_recipe_lines(lines, lookup).select("recipe_id", "line_no", "ingredient_id")


NAME_PRODUCTS = """SELECT p_partkey AS product_id, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE concat('[', p_brand, '] ', p_name, ' ', p_size, 'g') END AS name,
  concat(p_brand, ' > ', p_type) AS category_path FROM {part}"""
NAME_KEYS = """SELECT key, min(id) AS ingredient_id, min(id) AS key_order FROM (
  SELECT lower(split(p_name, ' ')[1]) AS key, 1000 + p_partkey AS id FROM {part} WHERE p_size > 20
  UNION ALL SELECT lower(replace(p_name, ' ', '')), p_partkey FROM {part} WHERE p_size > 25
  UNION ALL SELECT lower(p_type), 5000000 + p_partkey FROM {part} WHERE p_brand < 'Brand#2'
  UNION ALL SELECT lower(substring(p_type, 2, 3)), 9000000 + p_partkey FROM {part}) GROUP BY key"""


@register(
    "links_from_names",
    """WITH keys AS (SELECT key, min(id) AS id FROM (SELECT lower(split_part(p_name, ' ', 2)) AS key, 1000 + p_partkey AS id FROM part WHERE p_size > 20
  UNION ALL SELECT lower(replace(p_name, ' ', '')), p_partkey FROM part WHERE p_size > 25
  UNION ALL SELECT lower(p_type), 5000000 + p_partkey FROM part WHERE p_brand < 'Brand#2'
  UNION ALL SELECT lower(substring(p_type, 2, 3)), 9000000 + p_partkey FROM part) GROUP BY 1),
p AS (SELECT p_partkey AS product_id, lower(CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '[' || p_brand || ']' || replace(p_name, ' ', '') || p_size || 'g' END) AS t, lower(p_type) AS leaf FROM part),
by_name AS (SELECT product_id, key, id FROM p JOIN keys ON contains(t, key) WHERE length(key) >= 2
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY length(key) DESC, id) = 1),
by_leaf AS (SELECT product_id, key, id FROM p JOIN keys ON contains(leaf, key) WHERE length(key) >= 2
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY length(key) DESC, id) = 1)
SELECT p.product_id, coalesce(n.key, e.key, l.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.id WHEN e.key IS NOT NULL THEN e.id ELSE l.id END AS ingredient_id,
  'PRIMARY' AS role FROM p LEFT JOIN by_name n USING (product_id) LEFT JOIN keys e ON e.key = p.leaf LEFT JOIN by_leaf l USING (product_id)
WHERE coalesce(n.key, e.key, l.key) IS NOT NULL AND p.product_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0)""",
)
def links_from_names(spark, sf):
    linked = table(spark, sf, "lineitem").filter("l_discount = 0").select(F.col("l_partkey").alias("product_id"))
    return resolve.links_from_names(view(spark, sf, NAME_PRODUCTS), view(spark, sf, NAME_KEYS), linked)


@register(
    "match_summary",
    _sql("""SELECT count(*) AS lines, count(*) FILTER (WHERE key IN (SELECT key FROM matched)) AS matched_lines,
  count(*) FILTER (WHERE key IN (SELECT key FROM matched))::DOUBLE / count(*) AS match_rate,
  count(DISTINCT key) FILTER (WHERE key NOT IN (SELECT key FROM matched)) AS unmatched_names FROM keyed"""),
)
def match_summary(spark, sf):
    from mealgrid.functions.text import match_key
    from mealgrid.plans.reports import match_summary as summary

    lines = _lines(spark, sf).select(match_key(F.col("normalized_name")).alias("name"))
    return summary(lines, _matched(spark, sf)[1].select(F.col("normalized_name").alias("name")))


@register(
    "frequent_unmatched_names",
    _sql("SELECT normalized_name, count(*) AS occurrences FROM keyed WHERE key NOT IN (SELECT key FROM matched) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
)
def frequent_unmatched_names(spark, sf):
    from mealgrid.functions.text import match_key
    from mealgrid.plans.reports import frequent_values

    names, matched = _matched(spark, sf)
    lines = _lines(spark, sf).withColumn("key", match_key(F.col("normalized_name")))
    open_lines = lines.join(matched.select(F.col("normalized_name").alias("key")), "key", "left_anti")
    return frequent_values(open_lines, "normalized_name", 10)



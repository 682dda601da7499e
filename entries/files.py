"""Files: discovery over the given folder, and formats written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import TABLES, bind, table, view
from entries.registry import Registry, joined, num
from mealgrid.core.numbering import global_row_number
from mealgrid.core.scratch import new_folder
from mealgrid.sources import dumps, exchange, raw

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

DATASETS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS name, 1::BIGINT AS files, (SELECT count(*) FROM {t}) AS row_count" for t in TABLES
)


@register("discover_datasets", DATASETS_SQL)
def discover_datasets(spark, sf):
    return raw.dataset_list(raw.parquet_files(spark, sf)).select("name", "files", "row_count")


@register("sibling_catalog", f"SELECT name, row_count FROM ({DATASETS_SQL}) WHERE name <> 'orders'")
def sibling_catalog(spark, sf):
    return raw.sibling_catalog(raw.dataset_list(raw.parquet_files(spark, sf)), "orders").select("name", "row_count")


@register("read_parquet_group", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def read_parquet_group(spark, sf):
    files = raw.parquet_files(spark, sf)
    fingerprint = raw.dataset_list(files).filter("name = 'orders'").select("fingerprint").scalar()
    wanted = files.filter(F.col("fingerprint") == fingerprint)
    chosen = [r.fingerprint for r in wanted.select("fingerprint").distinct().collect()]
    return raw.read_parquet_group(spark, files, chosen[0]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


def _jsonl(spark, sf):
    """One file per priority, its orders sorted, a blank line after every order of more than 300,000."""
    folder = new_folder(spark, "jsonl")
    orders = table(spark, sf, "orders")
    good = F.to_json(F.struct("o_orderkey", "o_custkey", F.struct("o_orderpriority").alias("about")))
    line = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("[1, "), F.col("o_orderkey"), F.lit("]")))
        .when(F.col("o_totalprice") > 400000, F.substring(good, 1, 25))
        .otherwise(good)
    )
    blank = F.when(F.col("o_totalprice") > 300000, F.array(line, F.lit(" "))).otherwise(F.array(line))
    rows = orders.select("o_orderpriority", "o_orderkey", F.posexplode(blank).alias("place", "value"))
    rows = rows.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey", "place")
    rows.select("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(folder)
    return raw.read_jsonl(spark, folder, "o_orderkey BIGINT, o_custkey BIGINT, about STRUCT<o_orderpriority: STRING>")


@register(
    "read_jsonl",
    "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <= 400000",
)
def read_jsonl(spark, sf):
    return _jsonl(spark, sf)[0].select("o_orderkey", "o_custkey", "about.o_orderpriority")


@register(
    "read_jsonl_rejects",
    """SELECT o_orderpriority AS file, line_no, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_an_object' ELSE 'bad_json' END AS reason FROM (
SELECT *, 1 + coalesce(sum(CASE WHEN o_totalprice > 300000 THEN 2 ELSE 1 END)
  OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_no FROM orders)
WHERE o_orderstatus = 'P' OR o_totalprice > 400000""",
)
def read_jsonl_rejects(spark, sf):
    rejects = _jsonl(spark, sf)[1]
    folder = F.url_decode(F.regexp_extract("file", "o_orderpriority=([^/]*)", 1))
    key = F.regexp_extract("line", r"(?:\[1, |:)(\d+)", 1).cast("bigint")
    return rejects.select(F.url_decode(folder).alias("file"), "line_no", key.alias("o_orderkey"), "reason")


@register("read_json_records", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def read_json_records(spark, sf):
    folder = new_folder(spark, "json")
    # one document (file) per nation and segment, its records one level down under one of two keys
    entry = F.struct("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    docs = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.collect_list(entry).alias("rows"))
    under_data = docs.filter(F.col("c_mktsegment") < "C").withColumnRenamed("rows", "data")
    for part in (under_data, docs.filter(F.col("c_mktsegment") >= "C")):
        part.write.mode("append").partitionBy("c_nationkey", "c_mktsegment").json(folder)
    rows = raw.read_json_records(spark, folder)
    return rows.select("c_custkey", "c_name", F.col("nation").cast("int").alias("c_nationkey"))


@register(
    "read_csv",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(CASE WHEN trim(text) = '' THEN '' ELSE replace(text, chr(13), '') END) AS text_md5 FROM documents""",
)
def read_csv(spark, sf):
    folder = new_folder(spark, "csv")
    documents = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", "\r", "").alias("text"))
    documents.write.csv(folder, header=True, sep="\t", escape='"', quoteAll=True)
    rows = raw.read_csv(spark, folder, "\t")
    return rows.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@register(
    "dataset_brief",
    """SELECT doc_id, lang, CASE WHEN length(text) > 400 THEN md5(substring(text, 1, 400) || ' …(생략)') ELSE md5(text) END AS sample
FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20""",
)
def dataset_brief(spark, sf):
    documents = table(spark, sf, "documents").withColumn("size", -F.col("n_chars"))
    brief = raw.dataset_brief(documents, ["size", "doc_id"], 20)
    return brief.select("doc_id", "lang", F.md5("text").alias("sample"))


def _typed(name: str, columns: str, filled: str) -> str:
    """Facts of a table as SQL; ``columns`` lists (position, name, type)."""
    return f"""SELECT '{name}' AS dataset, v.column_no, v.name, v.type, count(*) AS row_count,
  count(*) FILTER (CASE v.column_no {filled} END) AS filled FROM {name}, (VALUES {columns}) v(column_no, name, type) GROUP BY ALL"""


@register(
    "dataset_facts",
    _typed(
        "documents",
        "(1, 'doc_id', 'bigint'), (2, 'text', 'string'), (3, 'lang', 'string'), (4, 'source', 'string'), (5, 'n_chars', 'bigint')",
        "WHEN 1 THEN doc_id IS NOT NULL WHEN 2 THEN text IS NOT NULL WHEN 3 THEN lang IS NOT NULL WHEN 4 THEN source IS NOT NULL ELSE n_chars IS NOT NULL",
    )
    + " UNION ALL "
    + _typed(
        "embeddings",
        "(1, 'vec_id', 'bigint'), (2, 'embedding', 'array<float>'), (3, 'label', 'int')",
        "WHEN 1 THEN vec_id IS NOT NULL WHEN 2 THEN embedding IS NOT NULL ELSE label IS NOT NULL",
    ),
)
def dataset_facts(spark, sf):
    facts = [raw.dataset_facts(table(spark, sf, n)).withColumn("dataset", F.lit(n)) for n in ("documents", "embeddings")]
    return facts[0].unionByName(facts[1])


@register(
    "select_by_columns",
    "SELECT p_partkey AS key, p_name AS name FROM part UNION ALL SELECT c_custkey, c_name FROM customer",
)
def select_by_columns(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey AS key", "p_name AS name", "p_size AS extra")
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    nations = table(spark, sf, "nation").selectExpr("n_nationkey AS key", "n_regionkey AS region")
    return raw.select_by_columns([parts, customers, nations], ["key", "name"]).select("key", "name")


# ---------------------------------------------------------------- dump and export


def _as_dump(batches):
    import pandas as pd

    yield pd.DataFrame({"value": ["-- dump", "COPY public.other (a) FROM stdin;", "COPY public.page (not a start)", "\\."]})
    yield pd.DataFrame({"value": ["COPY public.page (page_id, url, note, html) FROM stdin;"]})
    for batch in batches:
        yield batch[["value"]]
    yield pd.DataFrame({"value": ["\\.", "-- end"]})


@register(
    "read_copy_dump",
    "SELECT CAST(page_id AS VARCHAR) AS page_id, url, CAST(NULL AS VARCHAR) AS note, md5(html) AS html_md5 FROM pages",
)
def read_copy_dump(spark, sf):
    folder = new_folder(spark, "dump")
    html = F.replace("html", F.lit("\\"), F.lit("\\\\"))
    for raw_char, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\x0b", "\\v")):
        html = F.replace(html, F.lit(raw_char), F.lit(code))
    value = F.concat_ws("\t", F.col("page_id").cast("string"), "url", F.lit("\\N"), html)
    lines = table(spark, sf, "pages").select(value.alias("value")).repartition(4)
    lines.mapInPandas(_as_dump, "value string").write.text(folder)
    rows = dumps.read_copy_dump(spark, folder, "page", ["page_id", "url", "note", "html"])
    return rows.select("page_id", "url", "note", F.md5("html").alias("html_md5"))


@register(
    "export_insert_sql",
    """SELECT (r - 1) // 200 AS statement_no, 'INSERT INTO part (p_partkey, p_name, p_size) VALUES' || chr(10) ||
  string_agg('  (' || p_partkey || ', ''' || replace(p_name, 'a', '''''') || ''', ' || p_size || ')', ',' || chr(10) ORDER BY r) || ';' AS statement
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part) GROUP BY 1""",
)
def export_insert_sql(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_name", F.replace("p_name", F.lit("a"), F.lit("'")))
    kinds = {"p_partkey": "number", "p_name": "text", "p_size": "number"}
    return dumps.export_insert_sql(parts, "part", kinds, ["p_partkey"])


@register(
    "export_tables",
    """WITH t AS (
  SELECT 1 AS no, 'region' AS "table", '  (' || r_regionkey || ', ''' || r_name || ''')' AS x, row_number() OVER (ORDER BY r_regionkey) AS r FROM region
  UNION ALL SELECT 2, 'nation', '  (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')', row_number() OVER (ORDER BY n_nationkey) FROM nation
  UNION ALL SELECT 3, 'customer', '  (' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ')', row_number() OVER (ORDER BY c_custkey) FROM customer
), n AS (SELECT no, "table", count(*) AS rows_, 1 + ceil(count(*) / 200)::BIGINT AS statements FROM t GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(statements) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n)
SELECT start AS statement_no, "table", md5('-- ' || "table" || ': ' || rows_ || ' rows') AS statement FROM o
UNION ALL SELECT start + 1 + (r - 1) // 200, "table", md5('INSERT INTO ' || "table" || CASE "table" WHEN 'region' THEN ' (r_regionkey, r_name)'
    WHEN 'nation' THEN ' (n_nationkey, n_name, n_regionkey)' ELSE ' (c_custkey, c_name, c_nationkey)' END || ' VALUES' || chr(10)
    || string_agg(x, ',' || chr(10) ORDER BY r) || ';') FROM t JOIN o USING ("table") GROUP BY 1, 2""",
)
def export_tables(spark, sf):
    kinds = {"region": {"r_regionkey": "number", "r_name": "text"},
             "nation": {"n_nationkey": "number", "n_name": "text", "n_regionkey": "number"},
             "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number"}}
    refers = {"customer": ["nation"], "nation": ["region"], "region": []}
    listed = [
        dumps.ExportTable(n, table(spark, sf, n), kinds[n], [next(iter(kinds[n]))], refers[n]) for n in ("customer", "nation", "region")
    ]
    return dumps.export_tables(listed).withColumn("statement", F.md5("statement"))


# ---------------------------------------------------------------- requests and results


@register(
    "request_parts",
    """WITH RECURSIVE r AS (SELECT doc_id, CAST(floor(length(text) / 2.5::DOUBLE) + 1 AS BIGINT) AS tokens, row_number() OVER (ORDER BY doc_id) AS rn FROM documents
  WHERE floor(length(text) / 2.5::DOUBLE) + 1 <= 40000),
walk AS (SELECT rn, doc_id, tokens, 1::BIGINT AS part_no, 1::BIGINT AS cnt, tokens AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.rn, r.doc_id, r.tokens,
    CASE WHEN w.cnt >= 40 OR w.used + r.tokens > 40000 THEN w.part_no + 1 ELSE w.part_no END,
    CASE WHEN w.cnt >= 40 OR w.used + r.tokens > 40000 THEN 1 ELSE w.cnt + 1 END,
    CASE WHEN w.cnt >= 40 OR w.used + r.tokens > 40000 THEN r.tokens ELSE w.used + r.tokens END
  FROM walk w JOIN r ON r.rn = w.rn + 1)
SELECT doc_id AS custom_id, tokens, part_no FROM walk""",
)
def request_parts(spark, sf):
    requests = table(spark, sf, "documents").select(F.col("doc_id").alias("custom_id"), "text")
    return exchange.request_parts(requests, ["custom_id"], 40, 40_000).select("custom_id", "tokens", "part_no")


@register(
    "request_rejects",
    """SELECT CAST(doc_id AS VARCHAR) AS custom_id, 'over the token limit' AS reason FROM documents WHERE floor(length(text) / 2.5::DOUBLE) + 1 > 4000
UNION ALL SELECT source, 'repeated id' FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def request_rejects(spark, sf):
    docs = table(spark, sf, "documents")
    long = exchange.request_rejects(docs.select(F.col("doc_id").cast("string").alias("custom_id"), "text"), 4000)
    repeated = exchange.request_rejects(docs.select(F.col("source").alias("custom_id"), F.lit("").alias("text")), 4000)
    return long.union(repeated)


@register(
    "request_part_files",
    "SELECT count(*) AS requests, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations WHERE floor(length(text) / 2.5::DOUBLE) + 1 <= 20000",
)
def request_part_files(spark, sf):
    folder = new_folder(spark, "parts")
    requests = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"), "text"
    )
    exchange.write_request_parts(exchange.request_parts(requests, ["custom_id"], 50, 20_000), folder)
    back = spark.read.json(folder)
    return back.agg(F.count("*").alias("requests"), F.sum(F.length("text")).alias("characters"))


# an answer line per conversation turn; the way it fails follows from role, turn and length
RESULT_LINE = """SELECT concat(conv_id, '-', turn) AS custom_id, concat('{{"custom_id": "', conv_id, '-', turn, '", ',
  CASE WHEN role = 'system' THEN '"error": {{"code": "x"}}, "response": null'
       WHEN turn = 7 THEN '"response": "none"'
       WHEN turn = 6 THEN '"response": {{"status_code": 500, "body": {{}}}}'
       WHEN turn = 5 THEN '"response": {{"status_code": 200, "body": []}}'
       WHEN turn = 4 THEN '"response": {{"status_code": 200, "body": {{"choices": []}}}}'
       WHEN length(text) % 7 = 0 THEN '"response": {{"status_code": 200, "body": {{"choices": [{{"message": "text"}}]}}}}'
       WHEN length(text) % 7 = 1 THEN '"response": {{"status_code": 200, "body": {{"choices": [{{"message": {{"content": null, "refusal": "no"}}}}]}}}}'
       WHEN length(text) % 7 = 2 THEN '"response": {{"status_code": 200, "body": {{"choices": [{{"message": {{"content": "  "}}}}]}}}}'
       ELSE concat('"response": {{"status_code": 200, "body": {{"choices": [{{"message": {{"content": ',
         to_json(named_struct('c', CASE WHEN length(text) % 7 = 3 THEN concat('{{"size": "', length(text), ' x"}}') ELSE concat('{{"size": ', length(text), '}}') END)),
         '}}}}]}}}}') END, '}}') AS value
FROM {conversations}"""

RESULT_REASON = """CASE WHEN role = 'system' THEN 'batch_error' WHEN turn = 7 THEN 'missing_response' WHEN turn = 6 THEN 'http_error'
  WHEN turn = 5 THEN 'missing_body' WHEN turn = 4 THEN 'empty_choices' WHEN length(text) % 7 = 0 THEN 'bad_message'
  WHEN length(text) % 7 = 1 THEN 'refusal' WHEN length(text) % 7 = 2 THEN 'empty_content' END"""


def _result_lines(spark, sf):
    folder = new_folder(spark, "results")
    lines = view(spark, sf, RESULT_LINE).withColumn(
        "value", F.regexp_replace("value", r'"content": \{"c":("(?:[^"\\]|\\.)*")\}', '"content": $1')
    )
    lines.select("value").write.text(folder)
    return exchange.classified_results(spark.read.text(folder))


@register("classified_results", f"SELECT conv_id || '-' || turn AS custom_id, {RESULT_REASON} AS reason FROM conversations")
def classified_results(spark, sf):
    return _result_lines(spark, sf).select("custom_id", "reason")


@register(
    "parsed_results",
    f"""SELECT conv_id || '-' || turn AS custom_id, length(text) AS size FROM conversations
WHERE ({RESULT_REASON}) IS NULL AND length(text) % 7 <> 3""",
)
def parsed_results(spark, sf):
    return exchange.parsed_results(_result_lines(spark, sf), "size BIGINT")[0]


@register(
    "failed_results",
    f"""SELECT reason, count(*) AS n FROM (SELECT coalesce({RESULT_REASON}, CASE WHEN length(text) % 7 = 3 THEN 'schema_validation' END) AS reason
FROM conversations) WHERE reason IS NOT NULL GROUP BY 1""",
)
def failed_results(spark, sf):
    failures = exchange.parsed_results(_result_lines(spark, sf), "size BIGINT")[1]
    return failures.groupBy("reason").agg(F.count("*").alias("n"))


def _case_file(spark, sf):
    """Files by remainder of the id; four lines for each item: a comment, a blank, a case and a broken case."""
    folder = new_folder(spark, "cases")
    benchmark = table(spark, sf, "benchmark")
    question = F.regexp_replace("text", r"\s+", " ")
    good = F.to_json(F.struct(F.col("item_id").cast("string").alias("case_id"), question.alias("question")))
    lines = F.array(F.lit("// case"), F.lit("   "), good, F.substring(good, 1, 30))
    rows = benchmark.select((F.col("item_id") % 3).alias("part"), "item_id", F.posexplode(lines).alias("place", "value"))
    rows = rows.repartition("part").sortWithinPartitions("part", "item_id", "place").select("part", "value")
    rows.write.partitionBy("part").text(folder)
    return exchange.read_cases(spark, folder, "case_id STRING, question STRING")


@register(
    "read_cases",
    r"SELECT CAST(item_id AS VARCHAR) AS case_id, md5(regexp_replace(text, '\s+', ' ', 'g')) AS question_md5 FROM benchmark",
)
def read_cases(spark, sf):
    return _case_file(spark, sf)[0].select("case_id", F.md5("question").alias("question_md5"))


@register(
    "broken_cases",
    """SELECT item_id % 3 AS part, 4 * row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS line_no,
  substring('{"case_id":"' || item_id || '"', 1, 30) AS starts FROM benchmark""",
)
def broken_cases(spark, sf):
    part = F.regexp_extract("file", "part=([^/]*)", 1).cast("bigint").alias("part")
    starts = F.regexp_extract("line", r'^\{"case_id":"\d+"', 0).alias("starts")
    return _case_file(spark, sf)[1].select(part, "line_no", starts)


@register("read_experiment", "SELECT CAST(item_id AS VARCHAR) AS case_id, length(text) AS elapsed_ms FROM benchmark")
def read_experiment(spark, sf):
    folder = new_folder(spark, "experiment")
    rows = table(spark, sf, "benchmark").select(
        F.to_json(F.struct(F.col("item_id").cast("string").alias("case_id"), F.length("text").alias("elapsed_ms"))).alias("value")
    )
    meta = table(spark, sf, "region").select(F.to_json(F.struct(F.col("r_name").alias("experiment"))).alias("value"))
    meta.unionByName(rows).write.text(folder)
    return exchange.read_experiment(spark, folder, "case_id STRING, elapsed_ms BIGINT")


@register(
    "review_config",
    "SELECT p_partkey AS key, p_brand || '+' || p_type AS aliases, CASE WHEN p_size > 25 THEN 'INSERT' ELSE 'RENAME' END AS action FROM part",
)
def review_config(spark, sf):
    folder = new_folder(spark, "review")
    view(spark, sf, """SELECT p_partkey AS key, concat(p_brand, '|', p_type, '|') AS aliases,
        CASE WHEN p_size > 25 THEN 'INSERT' ELSE 'RENAME' END AS action FROM {part}""").write.csv(folder, header=True)
    rules = exchange.with_allowed_values(raw.read_csv(spark, folder), "action", ["INSERT", "RENAME"])
    lists = exchange.review_list(F.col("aliases"))
    return rules.select(F.col("key").cast("bigint").alias("key"), F.array_join(lists, "+").alias("aliases"), "action")


@register("write_staging", "SELECT user_id, product_id, CAST(quantity AS DOUBLE) AS quantity FROM user_fridge")
def write_staging(spark, sf):
    folder = new_folder(spark, "staging")
    exchange.write_staging(bind(spark, sf).user_fridge, folder)
    return spark.read.parquet(folder).select("user_id", "product_id", num("quantity"))


@register(
    "write_report",
    """SELECT ingredient_id, storage_location, storage_context, count(*) AS others FROM (
SELECT DISTINCT s.ingredient_id, s.storage_location, s.storage_context, trim(s.source_food_name || ' ' || coalesce(s.source_food_subtitle, '')) || ': ' || s.duration_text AS other
FROM storage_staging s JOIN storage_guideline g USING (ingredient_id, storage_location, storage_context)
WHERE s.source_item_id <> g.storage_id AND (SELECT count(DISTINCT (x.duration_min, x.duration_max, x.duration_unit))
  FROM storage_staging x WHERE x.ingredient_id = s.ingredient_id AND x.storage_location = s.storage_location
  AND x.storage_context = s.storage_context) > 1) GROUP BY 1, 2, 3""",
)
def write_report(spark, sf):
    from entries.binding import storage_staging
    from mealgrid.plans.storage import representative_decisions

    folder = new_folder(spark, "report")
    exchange.write_report(representative_decisions(storage_staging(spark, sf)), folder)
    back = spark.read.schema("ingredient_id BIGINT, storage_location STRING, storage_context STRING, other STRING").json(folder)
    return back.groupBy("ingredient_id", "storage_location", "storage_context").agg(F.count("*").alias("others"))


@register(
    "name_records",
    """SELECT CAST(l_orderkey AS VARCHAR) AS source_recipe_id, string_agg(raw, '|' ORDER BY line_no) AS ingredients FROM (
SELECT l_orderkey, l_partkey * 10 + l_linenumber AS line_no, min(p_name || ' ' || CAST(l_quantity AS INTEGER) || 'g') AS raw
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY l_orderkey""",
)
def name_records(spark, sf):
    folder = new_folder(spark, "records")
    lines = view(spark, sf, """SELECT l_orderkey AS recipe_id, concat('recipe ', l_orderkey) AS recipe_name, l_partkey * 10 + l_linenumber AS line_no,
        min(struct(concat(p_name, ' ', CAST(l_quantity AS INT), 'g') AS raw, p_name AS name, concat(CAST(l_quantity AS INT), 'g') AS quantity)) AS x
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey * 10 + l_linenumber""")
    records = exchange.name_records(lines.select("recipe_id", "recipe_name", "line_no", "x.name", "x.quantity"))
    exchange.write_report(records, folder)
    back = spark.read.json(folder)
    return back.select("source_recipe_id", joined("ingredients.raw_text", "ingredients"))


@register(
    "global_row_number",
    "SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_shipdate, l_quantity, l_linenumber, l_suppkey) AS row_no FROM lineitem",
)
def number_all_rows(spark, sf):
    order = [F.col("l_extendedprice").desc()] + [
        F.col(c).asc() for c in ("l_orderkey", "l_partkey", "l_shipdate", "l_quantity", "l_linenumber", "l_suppkey")
    ]
    rows = global_row_number(table(spark, sf, "lineitem"), order)
    return rows.select("l_orderkey", "l_partkey", "l_extendedprice", "row_no")

"""Ingredient name resolution: exact keys, cluster propagation, and answers for what is left.

"First seen wins" always means the lowest ordinal column, never the physical row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.numbering import global_row_number
from mealgrid.core.ranking import first_row
from mealgrid.core.scratch import written
from mealgrid.core.sizes import broadcast_if_small
from mealgrid.core.spread import spread
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.recipe_text import match_candidates
from mealgrid.functions.text import cluster_key, match_key, nonempty, stripped

KEY = "normalized_name"


def collect_names(lines: DataFrame) -> DataFrame:
    """Names to resolve with their number of occurrences and the first display and raw text.

    ``lines`` has normalized_name, name, raw_text and ordinal.
    """
    key = match_key(F.col(KEY))
    first = F.min(F.struct("ordinal", F.col("name"), F.col("raw_text")))
    named = lines.withColumn("key", key).filter(F.col("key") != "")
    display = F.coalesce(nonempty(F.col("first.name")), F.col("key"))
    sample = F.coalesce(nonempty(F.col("first.raw_text")), display)
    return (
        named.groupBy("key")
        .agg(F.count(F.lit(1)).alias("occurrence"), first.alias("first"))
        .select(
            F.col("key").alias(KEY),
            stripped(display).alias("display_name"),
            stripped(sample).alias("sample_raw_text"),
            "occurrence",
        )
    )


def master_spellings(ingredient: DataFrame) -> DataFrame:
    """(key, ingredient_id, position): every spelling of the master, position 0 normalised, 1 name, 2+ aliases."""
    spellings = F.concat(
        F.array("normalized_name", "name"), F.coalesce("aliases", F.array().cast("array<string>"))
    )
    return (
        ingredient.select(
            "ingredient_id",
            F.col("name").alias("matched_name"),
            F.col("parent_ingredient_id").isNull().alias("is_top"),
            F.posexplode(spellings).alias("position", "spelling"),
        )
        .withColumn("key", match_key(F.col("spelling")))
        .filter(F.coalesce(F.col("key"), F.lit("")) != "")
    )


def match_lookup(ingredient: DataFrame) -> DataFrame:
    """key → lowest ingredient id over normalised names, names and aliases."""
    return master_spellings(ingredient).groupBy("key").agg(F.min("ingredient_id").alias("ingredient_id"))


def exact_match(names: DataFrame, ingredient: DataFrame) -> DataFrame:
    """Names found in the master by any spelling.

    All spellings are rows of one table, so this is a single equi-join. Among several ingredients
    of one key: normalised name before name before everything else (an alias, or a name that only
    matches once its inner blanks are removed), top item before child, then the lower id; that choice is made once per key with a partial + final minimum, before any name is joined.
    """
    as_written = F.lower(F.trim("spelling")) == F.col("key")
    rank = F.when((F.col("position") <= 1) & as_written, F.col("position")).otherwise(F.lit(2))
    best = (
        master_spellings(ingredient)
        .groupBy("key")
        .agg(F.min(F.struct(rank.alias("rank"), ~F.col("is_top"), "ingredient_id", "matched_name")).alias("best"))
        .select(F.col("key").alias(KEY), "best.ingredient_id", "best.matched_name")
    )
    return (
        names.join(best, KEY)
        .withColumn("method", F.lit("exact"))
        .withColumn("confidence", F.lit(1.0))
    )


def unmatched(names: DataFrame, matched: DataFrame) -> DataFrame:
    """Names without a match."""
    return names.join(matched.select(KEY), KEY, "left_anti")


def build_clusters(lines: DataFrame) -> DataFrame:
    """(cluster, key, n): how often each spelling stands for an original name."""
    return (
        lines.select(cluster_key(F.col("name_original")).alias("cluster"), match_key(F.col(KEY)).alias("key"))
        .filter((F.col("cluster") != "") & (F.col("key") != ""))
        .groupBy("cluster", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_clusters(clusters: DataFrame) -> DataFrame:
    """Number of clusters and of clusters with more than one spelling."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("variants"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("variants") > 1).alias("split_clusters")
    )


def _by_frequency() -> Column:
    return F.struct((-F.col("n")).alias("order"), F.col("key").alias("key"))


def propagate(clusters: DataFrame, matched: DataFrame) -> DataFrame:
    """(key, ingredient_id) gained: unmatched spellings take the id of their cluster's winner.

    The winner is the most frequent matched spelling. A spelling in several clusters takes the
    first cluster by name that can give an id.
    """
    known = matched.select(F.col(KEY).alias("key"), "ingredient_id")
    winners = (
        clusters.join(known, "key")
        .groupBy("cluster")
        .agg(F.min_by("ingredient_id", _by_frequency()).alias("ingredient_id"))
    )
    return (
        clusters.join(known, "key", "left_anti")
        .join(winners, "cluster")
        .groupBy("key")
        .agg(F.min_by("ingredient_id", "cluster").alias("ingredient_id"))
        .withColumnRenamed("key", KEY)
    )


def representatives(clusters: DataFrame, open_names: DataFrame) -> DataFrame:
    """(key, head) for every open name: the name asked in its place, or the name itself.

    A cluster with at least two open spellings is asked through its most frequent one; a spelling
    in several clusters follows the first cluster by name.
    """
    wanted = open_names.select(F.col(KEY).alias("key")).distinct()
    open_members = clusters.join(wanted, "key", "left_semi")
    heads = (
        open_members.groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("size"), F.min_by("key", _by_frequency()).alias("head"))
        .filter(F.col("size") >= 2)
    )
    delegates = (
        open_members.join(heads, "cluster").groupBy("key").agg(F.min_by("head", "cluster").alias("head"))
    )
    return (
        wanted.join(delegates, "key", "left")
        .select(F.col("key").alias(KEY), F.coalesce("head", "key").alias("head"))
    )


def request_chunks(names: DataFrame, size: int = fixed.NAMES_PER_REQUEST) -> DataFrame:
    """Names in blocks of ``size``, most frequent first: one row per block with its names in order."""
    numbered = global_row_number(names, [F.col("occurrence").desc(), F.col(KEY).asc()], "position")
    chunk = F.floor((F.col("position") - 1) / size)
    return (
        numbered.withColumn("chunk", chunk)
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(F.struct("position", KEY))).alias("entries"))
        .select("chunk", F.transform("entries", lambda e: e[KEY]).alias("names"))
    )


def requested_name(answers: DataFrame, requested: DataFrame, aliases: DataFrame) -> DataFrame:
    """Answers with the requested name they speak about; answers about anything else are left out.

    ``aliases`` holds (alias, normalized_name, ordinal): other spellings sent with a request. An
    alias that is itself a requested name does not count, and the first request of an alias wins.
    """
    wanted = requested.select(F.col(KEY)).distinct()
    redirect = (
        aliases.withColumn("alias", match_key(F.col("alias")))
        .join(wanted, KEY, "left_semi")
        .join(wanted.withColumnRenamed(KEY, "alias"), "alias", "left_anti")
        .groupBy("alias")
        .agg(F.min_by(KEY, "ordinal").alias("alias_of"))
    )
    said = match_key(F.col("source_name"))
    return (
        answers.withColumn("alias", said)
        .join(redirect, "alias", "left")
        .withColumn(KEY, F.coalesce("alias_of", "alias"))
        .drop("alias", "alias_of")
        .join(wanted, KEY, "left_semi")
    )


def judged_answers(
    answers: DataFrame, offered: DataFrame, min_confidence: float = fixed.MIN_CONFIDENCE
) -> DataFrame:
    """The first answer per name with ``rejection``: no id, low confidence, or an id that was not offered."""
    first = first_row(answers, [KEY], [F.col("ordinal").asc()])
    ids = offered.select("ingredient_id").distinct().withColumn("offered", F.lit(True))
    rejection = (
        F.when(F.col("ingredient_id").isNull(), "매칭 없음")
        .when(F.col("confidence") < min_confidence, "확신도 미달")
        .when(F.col("offered").isNull(), F.format_string("후보에 없는 ingredient_id(%d)", F.col("ingredient_id")))
    )
    return first.join(ids, "ingredient_id", "left").withColumn("rejection", rejection).drop("offered")


def unanswered(requested: DataFrame, judged: DataFrame) -> DataFrame:
    """Requested names nobody answered."""
    return requested.select(KEY).distinct().join(judged.select(KEY), KEY, "left_anti")


def expand_delegates(delegates: DataFrame, accepted: DataFrame, failed: DataFrame) -> DataFrame:
    """Variants take over the result of the name asked in their place.

    ``outcome`` is ``cluster`` (id taken over) or ``failed`` (the head has no match either).
    """
    ids = accepted.select(F.col(KEY).alias("head"), "ingredient_id", "confidence")
    lost = failed.select(F.col(KEY).alias("head")).distinct().withColumn("head_failed", F.lit(True))
    variants = (
        delegates.filter(F.col(KEY) != F.col("head"))
        .join(accepted.select(KEY), KEY, "left_anti")
        .join(ids, "head", "left")
        .join(lost, "head", "left")
        .join(failed.select(KEY).distinct().withColumn("own_failed", F.lit(True)), KEY, "left")
    )
    outcome = F.when(F.col("ingredient_id").isNotNull(), "cluster").when(
        F.col("head_failed") & F.col("own_failed").isNull(), "failed"
    )
    return (
        variants.withColumn("outcome", outcome)
        .filter(F.col("outcome").isNotNull())
        .drop("head_failed", "own_failed")
    )


def resolve_report(matched: DataFrame, open_names: DataFrame) -> DataFrame:
    """Names per method, open names, and the share matched."""
    methods = matched.groupBy("method").agg(F.count(F.lit(1)).alias("names"))
    still_open = open_names.agg(F.count(F.lit(1)).alias("names")).select(F.lit("unmatched").alias("method"), "names")
    rows = methods.unionByName(still_open)
    total = rows.select(F.sum("names").alias("n")).scalar()
    return rows.withColumn("share", F.col("names") / total)


def link_recipe_lines(lines: DataFrame, lookup: DataFrame) -> DataFrame:
    """Recipe lines with the ingredient of the first candidate spelling that is known (NULL when none is)."""
    tried = lines.select("recipe_id", "line_no", F.posexplode(match_candidates(F.col("name"))).alias("pos", "spelling"))
    hits = (
        tried.withColumn("key", match_key(F.col("spelling")))
        .join(lookup.select("key", "ingredient_id"), "key")
        .groupBy("recipe_id", "line_no")
        .agg(F.min(F.struct("pos", "key", "ingredient_id")).alias("hit"))
        .select("recipe_id", "line_no", F.col("hit.key").alias("matched_key"), "hit.ingredient_id")
    )
    return lines.join(hits, ["recipe_id", "line_no"], "left")


CHUNK = 256  # starts of a chunk of a text
HEAD = 4  # leading characters by which a key is looked up


def _longest_contained(texts: DataFrame, text: str, keys: DataFrame, result: str) -> DataFrame:
    """(text, longest known key inside it); equal lengths go to the lower ``key_order``.

    Distinct texts are cut into chunks that overlap by the longest key, so a long text is many rows. Each start in a chunk looks
    keys up by their first ``HEAD`` characters (all of them in shorter keys), and those that the text goes on with are compared
    there. Rows carry a piece as long as the longest key and a hash of the text, never the text itself.
    """
    lexicon = written(keys.withColumn("head", F.substring("key", 1, HEAD)), "keys")
    known = lexicon.agg(F.array_sort(F.collect_set(F.length("head"))).alias("lengths"), F.max(F.length("key")).alias("longest")).first()
    whole = texts.select(F.col(text).alias("t")).distinct().filter(F.length("t") >= fixed.MIN_SUBSTRING)
    whole = whole.select("t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"))
    longest = known["longest"] or 0
    chunks = whole.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("t"), F.lit(CHUNK)))).select(
        "h1", "h2", F.substring(F.col("t"), F.col("start"), F.lit(CHUNK - 1 + longest)).alias("chunk")
    )
    starts = spread(chunks, "h1", "chunk").withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(CHUNK)))))
    piece = F.substring(F.col("chunk"), F.col("i"), F.lit(longest))
    lengths = F.array(*[F.lit(n) for n in known["lengths"]]).cast("array<int>")
    heads = F.filter(lengths, lambda n: n <= F.length("piece"))
    pieces = starts.select("h1", "h2", piece.alias("piece")).withColumn("n", F.explode(heads))
    pieces = pieces.withColumn("head", F.substring(F.col("piece"), F.lit(1), F.col("n"))).drop("n")
    best = F.min(F.struct((-F.length("key")).alias("size"), "key_order", "key", "ingredient_id")).alias("best")
    found = (
        pieces.join(broadcast_if_small(lexicon), "head").where(F.startswith("piece", F.col("key"))).groupBy("h1", "h2").agg(best)
    )
    return whole.join(found, ["h1", "h2"]).select(F.col("t").alias(text), F.struct("best.key", "best.ingredient_id").alias(result))


def links_from_names(products: DataFrame, lookup: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """One main ingredient per product read off its name, else off its category leaf.

    Products in ``linked`` (product_id) have links already and are left alone.

    ``products`` has product_id, name and category_path; ``lookup`` has key, ingredient_id and
    key_order (the order of equally long keys). The longest key inside the name wins; without one,
    the leaf itself when it is a key, then the longest key inside the leaf.
    """
    if linked is not None:
        products = products.join(linked.select("product_id").distinct(), "product_id", "left_anti")
    keys = lookup.filter(F.length("key") >= fixed.MIN_SUBSTRING).select("key", "ingredient_id", "key_order")
    leaf_text = F.element_at(F.split(F.coalesce("category_path", F.lit("")), fixed.PATH_SEPARATOR), -1)
    texts = products.select(
        "product_id", match_key(F.col("name")).alias("in_name"), match_key(leaf_text).alias("in_leaf")
    )
    exact = lookup.select(F.col("key").alias("in_leaf"), F.struct("key", "ingredient_id").alias("leaf_exact"))
    chosen = F.coalesce("by_name", "leaf_exact", "by_leaf")
    return (
        texts.join(_longest_contained(texts, "in_name", keys, "by_name"), "in_name", "left")
        .join(exact, "in_leaf", "left")
        .join(_longest_contained(texts, "in_leaf", keys, "by_leaf"), "in_leaf", "left")
        .withColumn("chosen", chosen)
        .filter(F.col("chosen").isNotNull())
        .select("product_id", F.col("chosen.key").alias("key"), F.col("chosen.ingredient_id").alias("ingredient_id"),
                F.lit(fixed.PRIMARY).alias("role"))
    )

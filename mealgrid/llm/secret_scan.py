"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Three kinds are found by pattern (``assign``, ``access``, ``hex``). The kind ``markov`` adds tokens that no pattern
names: a character bigram model of random strings and one of ordinary identifiers are trained from labelled samples,
and a token whose log-likelihood ratio reaches ``min_llr`` nats is a secret. Scanning is one narrow pass without a
shuffle: the two models are one array of ``SYMBOLS * SYMBOLS`` ratios, whatever the corpus size, folded into the plan
as a literal.

Spans are code points, end exclusive. Null and empty texts have no spans. Rows are scanned one by one, so repeated
rows and ids give repeated results; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import let

# --- fixed values of the contract -------------------------------------------------------------------------------
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # shorter runs fail anyway and a run cannot start inside another one
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "markov")

# --- parameters of the Markov kind --------------------------------------------------------------------------------
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLE_TOKEN = r"[A-Za-z0-9+/_=-]{6,}"
FIRST_SYMBOL, SYMBOLS = 32, 96  # printable ASCII
RANDOM_STRINGS = 3000  # digests written in hexadecimal and in base 64
MIN_LLR = 14.0
SMOOTHING = 0.2


def _codes(token: Column) -> Column:
    """Symbol numbers of a token's characters."""
    return F.transform(F.split(token, ""), lambda c: F.ascii(c) - F.lit(FIRST_SYMBOL))


def _bigrams(token: Column) -> Column:
    """Number of each transition: previous symbol times ``SYMBOLS`` plus next symbol."""
    return let(
        _codes(token),
        lambda codes: F.transform(
            F.sequence(F.lit(1), F.size(codes) - 1),
            lambda i: F.get(codes, i - 1) * F.lit(SYMBOLS) + F.get(codes, i),
        ),
    )


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, random, n): the tokens of all documents with their number, and digests as random strings.

    Tokens are counted inside the tasks first, so one that is everywhere is a row per task. Those that a pattern finds are left
    out of the ordinary ones.
    """
    spark = docs.sparkSession
    plain = F.regexp_replace(F.regexp_replace(F.col(text_col), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(SAMPLE_TOKEN), F.lit(0))).alias("token"))
    counted = ordinary.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    drawn = spark.range(RANDOM_STRINGS).select(
        F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))).alias("token")
    )
    one = F.lit(1).cast("long")
    return counted.select("token", F.lit(False).alias("random"), "n").union(drawn.select("token", F.lit(True), one))


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary, from samples (token, random, n).

    Only the counts of at most ``2 * SYMBOLS ** 2`` transitions reach the driver. Without samples all ratios are 0.
    """
    counts = (
        samples.where(F.length("token") >= 2)
        .select("random", "n", F.explode(_bigrams(F.col("token"))).alias("gram"))
        .groupBy("random", "gram")
        .agg(F.sum("n").alias("count"))
    )
    seen: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in counts.collect():
        seen[row["random"]][row["gram"]] = row["count"]
    ratios = [0.0] * (SYMBOLS * SYMBOLS)
    if not seen[True] or not seen[False]:
        return ratios
    totals = {label: [0.0] * SYMBOLS for label in seen}
    for label, grams in seen.items():
        for gram, n in grams.items():
            totals[label][gram // SYMBOLS] += n
    for gram in range(SYMBOLS * SYMBOLS):
        likely = {
            label: (seen[label].get(gram, 0) + smoothing) / (totals[label][gram // SYMBOLS] + smoothing * SYMBOLS)
            for label in seen
        }
        ratios[gram] = math.log(likely[True] / likely[False])
    return ratios


def llr(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a whole token."""
    model = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")  # folded once
    return F.aggregate(_bigrams(token), F.lit(0.0), lambda total, gram: total + F.get(model, gram))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Kept matches of one pattern as (start, end, kind number), from the lengths of matches and of what is between."""

    def located(matches: Column, between: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")
        begin = F.struct(F.lit(0).alias("at"), empty.alias("found"))

        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(between, i))
            end = start + F.length(F.get(matches, i))
            span = F.struct(
                start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
                F.get(matches, i).alias("token"),
            )
            return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

        walked = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), begin, step, lambda state: state["found"])
        return F.when(F.size(matches) > 0, F.filter(walked, lambda s: keep(s["token"]))).otherwise(empty)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda parts: located(m, parts))),
    )


def _listed(spans: Column) -> Column:
    """Spans as text, by start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(
    docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", min_llr: float = MIN_LLR
) -> DataFrame:
    """One row per document: id, and per kind the array of spans (start, end, kind, token)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")
    value = lambda token: F.regexp_extract(token, ASSIGN, 2)
    not_digits = lambda token: token.rlike("[A-Za-z]")
    rules = {
        "assign": (ASSIGN, lambda t: F.length(value(t)) >= MIN_ASSIGN),
        "access": (ACCESS, lambda t: F.length(t) >= MIN_ACCESS),
        "hex": (HEX, lambda t: F.lit(True)),
        "markov": (CANDIDATE, lambda t: not_digits(t) & (llr(t, ratios) >= min_llr)),
    }
    return docs.select(
        F.col(id_col),
        *[F.coalesce(_spans(text, p, kind, keep), empty).alias(kind) for kind, (p, keep) in rules.items()],
    )


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the pattern spans, and all spans as text."""
    base = F.concat("assign", "access", "hex")
    return found.select(
        F.col(id_col),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, F.col("markov"))).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )

"""Toxicity: a logistic classifier regularised by counterfactuals.

Features of a text are the set of its words and word beginnings (inflected languages share a stem under many endings).
From a bounded sample of labelled rows the features most tied to the label are chosen by likelihood ratio (G-test), the
identity terms are always among them. The classifier minimises

    mean log loss + ridge * |w|^2 / 2 + penalty * mean (score(sentence) - score(swapped sentence))^2

over the sample: every labelled sentence that names a group is paired with copies naming other groups of the same kind,
so neither a group's name nor its company may move the score. Scoring is one narrow pass over all texts with a
vocabulary of at most ``FEATURES`` entries plus the identity terms.

Bounds: ``SAMPLE_ROWS`` labelled rows (those with the smallest id hashes) are fitted; what reaches the driver is the
chosen vocabulary and the sample's distinct feature sets. Labels, language, source and id are never inputs of a score.

Null and empty texts have no features and get the base score. Rows are scored one by one: repeated rows get equal
scores; null ids are scored and count as not held out. Null labels are not learned from. Without both labels in the
sample the score is the smoothed share of label 1. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
FEATURES = 1_000
MIN_SIGNIFICANCE = 24.0  # G statistic of a feature that is chosen
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
RIDGE, PENALTY, STEPS = 1e-4, 1.0, 600
SWAPS = 3
#: Groups of interchangeable identity terms in the languages of the corpus; a fixed list, and a parameter of ``train``.
IDENTITY_TERMS = (
    # English
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("old", "young", "elderly"),
    # French
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("musulmane", "chrétienne", "juive", "hindoue"),
    ("noir", "blanc", "asiatique", "africain", "européen", "arabe"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("homosexuel", "lesbienne", "hétérosexuel", "bisexuel", "transgenre"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("sourd", "aveugle", "handicapé", "autiste"),
    ("immigré", "réfugié", "étranger", "migrant"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("vieux", "jeune", "âgé"),
    # German
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell", "transgender", "queer"),
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("weiblich", "männlich"),
    ("taub", "blind", "behindert", "autistisch"),
    ("einwanderer", "flüchtling", "ausländer", "migrant"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten"),
    ("alte", "junge", "ältere"),
    # Spanish
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("musulmana", "cristiana", "judía", "atea", "católica"),
    ("negro", "blanco", "asiático", "latino", "africano", "europeo", "árabe", "indígena"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos", "árabes", "indígenas"),
    ("gay", "lesbiana", "heterosexual", "bisexual", "transgénero"),
    ("mujer", "hombre", "niña", "niño"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("femenino", "masculino"),
    ("sordo", "ciego", "discapacitado", "autista"),
    ("inmigrante", "refugiado", "extranjero", "migrante"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("viejo", "joven", "anciano"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(words: set[str]) -> set[str]:
    """Words and, marked, their beginnings."""
    return words | {f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def text_words(text: str | None) -> set[str]:
    """Lower-case words of a text."""
    return set(_WORD.findall(text.lower())) if text else set()


def _feature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            found = list(features(text_words(text)))
            yield pd.DataFrame({"feature": found, "toxic": np.full(len(found), toxic, np.int64)})


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows; the caller leaves out of ``labels`` what is held out."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic"))
    chosen = chosen.where("__id IS NOT NULL AND toxic IN (0, 1)").orderBy(F.xxhash64("__id"), "__id", "toxic").limit(rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "toxic")  # at most ``rows`` pairs of numbers


def choose_features(sample: DataFrame, size: int = FEATURES) -> list[str]:
    """The features most tied to the label, by likelihood ratio; ties by name."""
    whole = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n, p = whole["n"], whole["p"] or 0
    if not 0 < p < n:
        return []
    counts = (
        sample.mapInPandas(_feature_rows, "feature string, toxic long")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("a"), F.sum("toxic").alias("b"))
        .where("a >= 3")
    )

    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g = 2 * (
        part(b, a, F.lit(float(p)))
        + part(a - b, a, F.lit(float(n - p)))
        + part(p - b, n - a, F.lit(float(p)))
        + part(n - p - a + b, n - a, F.lit(float(n - p)))
    )
    best = counts.withColumn("g", g).where(F.col("g") >= MIN_SIGNIFICANCE).orderBy(F.desc("g"), "feature").limit(size)
    return [row["feature"] for row in best.collect()]


def _design_rows(vocabulary: dict[str, int], groups):
    """Feature numbers of whole texts, and of sentences with their swapped copies."""
    # a term of several groups, as in two languages, is swapped within each of them
    others: dict[str, list[str]] = {}
    for group in groups:
        for term in group:
            others.setdefault(term, []).extend([t for t in group if t != term][:SWAPS])

    def numbers(words: set[str]) -> list[int]:
        return sorted(vocabulary[f] for f in features(words) if f in vocabulary)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words = text_words(text)
                out.append((int(toxic), numbers(words), None))
                if words.isdisjoint(others):
                    continue
                for sentence in _SENTENCE.split(text):
                    said = text_words(sentence)
                    for term in sorted(said & others.keys()):
                        for other in others[term]:
                            out.append((int(toxic), numbers(said), numbers((said - {term}) | {other})))
            yield pd.DataFrame(out, columns=["toxic", "said", "swapped"])

    return rows


class _Sets:
    """Sparse 0/1 rows."""

    def __init__(self, sets, width):
        self.index = np.array([i for s in sets for i in s], np.int64)
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int64)
        self.rows, self.width = len(sets), width

    def times(self, w):
        return np.bincount(self.row, w[self.index], self.rows) if self.rows else np.zeros(0)

    def transposed(self, v):
        return np.bincount(self.index, v[self.row], self.width) if self.rows else np.zeros(self.width)


def _score(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def fit(rows, width: int, ridge=RIDGE, penalty=PENALTY, steps=STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept from (toxic, said, swapped or None, count) rows; Adam on the whole sample."""
    texts = [r for r in rows if r[2] is None]
    pairs = [r for r in rows if r[2] is not None]
    n = np.array([r[3] for r in texts], float)
    y = np.array([r[0] for r in texts], float)
    rate = (n @ y + 1) / (n.sum() + 2) if len(n) else 0.5
    bias, w = math.log(rate / (1 - rate)), np.zeros(width)
    if not len(n) or not 0 < n @ y < n.sum():
        return w, bias
    x, a, b = (_Sets(s, width) for s in ([r[1] for r in texts], [r[1] for r in pairs], [r[2] for r in pairs]))
    share = n / n.sum()
    pair_share = np.array([r[3] for r in pairs], float)
    pair_share /= max(pair_share.sum(), 1.0)
    moment, spread = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        wrong = share * (_score(x.times(w) + bias) - y)
        grad, grad_bias = x.transposed(wrong) + ridge * w, wrong.sum()
        if pairs:
            s, t = _score(a.times(w) + bias), _score(b.times(w) + bias)
            move = 2 * penalty * pair_share * (s - t)
            up, down = move * s * (1 - s), move * t * (1 - t)
            grad = grad + a.transposed(up) - b.transposed(down)
            grad_bias += up.sum() - down.sum()
        g = np.append(grad, grad_bias)
        moment = 0.9 * moment + 0.1 * g
        spread = 0.999 * spread + 0.001 * g * g
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def swapped_pairs(sample: DataFrame, groups=IDENTITY_TERMS) -> int:
    """How many pairs of a sentence and its swapped copy a sample gives the fit; without any the classifier is plain."""
    terms = {f: i for i, f in enumerate(dict.fromkeys(t for group in groups for t in group))}
    design = sample.mapInPandas(_design_rows(terms, groups), "toxic int, said array<int>, swapped array<int>")
    return design.where("swapped IS NOT NULL").count()


def train(sample: DataFrame, groups=IDENTITY_TERMS, size: int = FEATURES, penalty: float = PENALTY) -> tuple[dict, float]:
    """(weight of each feature, intercept) from a bounded sample of (text, toxic)."""
    terms = [term for group in groups for term in group]
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*choose_features(sample, size), *terms]))}
    design = (
        sample.mapInPandas(_design_rows(vocabulary, groups), "toxic int, said array<int>, swapped array<int>")
        .groupBy("toxic", "said", "swapped")
        .count()
        .orderBy("toxic", "said", "swapped")
    )
    rows = [tuple(r) for r in design.collect()]
    weights, bias = fit(rows, len(vocabulary), penalty=penalty)
    return {f: float(weights[i]) for f, i in vocabulary.items() if weights[i]}, bias


def scored(docs: DataFrame, model: tuple[dict, float], text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``."""
    weights, bias = model
    stems = {f[1:]: v for f, v in weights.items() if f.startswith("^")}
    whole = {f: v for f, v in weights.items() if not f.startswith("^")}

    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            margin, hit = bias, set()
            for word in text_words(text):
                margin += whole.get(word, 0.0)
                for n in PREFIXES:
                    if len(word) <= n:
                        break
                    if word[:n] in stems:
                        hit.add(word[:n])
            out[k] = margin + sum(stems[s] for s in sorted(hit))
        return pd.Series(_score(out))

    return docs.withColumn("score", F.pandas_udf(score, "double")(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def model_of(docs: DataFrame, labels: DataFrame) -> tuple[dict, float]:
    """The classifier for a corpus, learned from the rows that are not held out."""
    return train(labelled_sample(docs, labels.where(~held_out())))


def keep_clean(docs: DataFrame, model: tuple[dict, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; all columns."""
    rows = docs.select(F.struct("*").alias("__doc"), F.col(text_col).alias("__text"))
    return scored(rows, model, "__text").where(F.col("score") < threshold).select("__doc.*")

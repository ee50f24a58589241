"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learnt: words, and beginnings of words, that stand in toxic texts far more often than in
others, with their shrunken log-odds (a short list of insults is in it from the start). Features are its
densities (plain, spelled with look-alike characters, distinct, the strongest hits), hits near a
second-person word, capitals, exclamation marks, other punctuation, digits, obfuscation and sizes.

Labels are learnt from at most ``max_rows`` documents, a sample by a hash of the id. The lexicon comes
from one half of them, the trees from three eighths, the calibration from the last eighth, so that trees
see a lexicon that was learnt elsewhere. Null text counts as empty. Rows that repeat a labelled
``doc_id`` are one document (the least text, the highest label). Where the labels hold one class only,
or none, or a part is left without both classes, nothing was learnt: every score is the share of toxic
labels, but below 0.5, so that no document is taken for toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ledgerlens.llm.common import remainder, small_batches, whole
from ledgerlens.session import materialize

MAX_ROWS = 20_000
HELD_OUT_MODULUS = 5
NEAR = 5
# A table of tokens is emptied when it is full: it only saves time.
KNOWN_TOKENS = 50_000
# A leaf of fewer rows would learn the noise of the labels.
LEAF_ROWS = 10
# How much of the score is the trees' own: it only orders texts with the same calibrated value.
OWN_SHARE = 0.01
# The lexicon: entries at most, toxic texts of an entry at least, its log-odds at least, lengths of beginnings.
ENTRIES = 20_000
LEAST = 3
LEAST_ODDS = 1.5
STEMS = (4, 5, 6)
# Log-odds from which a word is a hit, and how many of the strongest words are added up.
STRONG = 3.0
BEST = 8
# Of eight parts of the labelled documents: the lexicon's, then the trees', then the calibration's.
PARTS = 8
LEXICON_PARTS = 4
TREE_PARTS = 7
# Score of every document where nothing could be learnt, at most.
UNDECIDED = 0.49

# Insults and second-person words.
INSULTS = frozenset(
    "worthless pathetic moron morons loser losers clown clowns disgusting trash idiot idiots scum stupid dumb imbecile "
    "garbage vermin filth filthy ugly fool jerk creep freak scumbag dumbass retard bastard bitch asshole "
    "dummkopf abschaum arschloch widerlich imbécile débile ordure connard salaud idiota estúpido imbécil basura".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi ton ta vous votre tú ti te usted ustedes vosotros".split()
)
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:?!\"'()[]{}<>«»¿¡-–—_*~`…"
_CAPITAL = regex.compile(r"\p{Lu}")
_RUNS = re.compile(r"(.)\1+")
_SEPARATORS = re.compile(r"[^\w@$!|]|_")
_SPACED = re.compile(r"(?<!\S)(?:\w[ .\-_*]){3,}\w(?!\S)")


class Lexicon:
    """Log-odds of words and of beginnings of words (``^`` and their letters), with a table of tokens met."""

    def __init__(self, odds: dict[str, float] | None = None):
        self.odds = odds or {}
        self._known: dict[str, tuple[int, str, float]] = {}

    def __reduce__(self):
        return Lexicon, (self.odds,)

    def weight(self, word: str) -> float:
        """The strongest of the word's entries; nothing for words that are not in the lexicon."""
        return max((self.odds.get(e, 0.0) for e in entries_of(word)), default=0.0)

    def kind(self, token: str) -> tuple[int, str, float]:
        """0 plain, 1 insult, 2 insult in disguise, 3 second person, 4 letters mixed with look-alikes."""
        found = self._known.get(token)
        if found is None:
            bare = token.strip(_EDGES)
            if bare in INSULTS:
                found = (1, bare, max(STRONG, self.weight(bare)))
            elif bare in SECOND_PERSON:
                found = (3, bare, 0.0)
            else:
                mixed = not bare.isalpha() and any(c.isalpha() for c in bare)
                plain = _SEPARATORS.sub("", bare).translate(LOOKALIKE) if mixed else bare
                short = _RUNS.sub(r"\1", plain)
                hidden = next((w for w in (plain, short) if w in INSULTS), None)
                weight = max(self.weight(plain), self.weight(short) if short != plain else 0.0)
                if hidden:
                    found = (2, hidden, max(STRONG, weight))
                else:
                    found = (4 if mixed else 0, plain, weight)
            if len(self._known) > KNOWN_TOKENS:
                self._known.clear()
            self._known[token] = found
        return found


def entries_of(word: str) -> list[str]:
    """What the lexicon may know of a word: itself and its beginnings."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def text_features(text: str, lexicon: Lexicon = Lexicon()) -> list[float]:  # noqa: B008
    """The dense features of one text; all finite, also for the empty text."""
    lower = text.lower()
    hits: list[int] = []
    persons: list[int] = []
    insults: set[str] = set()
    weights: dict[str, float] = {}
    plain = hidden = mixed = n = letters = strong = 0
    for n, token in enumerate(_TOKEN.findall(lower), 1):
        letters += len(token)
        kind, word, weight = lexicon.kind(token)
        if weight:
            weights[word] = weight
            if weight >= STRONG:
                strong += 1
                hits.append(n)
        if kind:
            if kind == 3:
                persons.append(n)
            elif kind == 4:
                mixed += 1
            else:
                insults.add(word)
                plain += kind == 1
                hidden += kind == 2
    for run in _SPACED.findall(lower):
        joined = _SEPARATORS.sub("", run.replace(" ", ""))
        weight = max(lexicon.weight(joined), STRONG if joined in INSULTS else 0.0)
        if weight >= STRONG:
            weights[joined] = weight
            hidden += 1
    near, at = 0, 0
    for i in hits:
        while at < len(persons) and persons[at] < i - NEAR:
            at += 1
        near += at < len(persons) and persons[at] <= i + NEAR
    words, chars = max(n, 1), max(len(text), 1)
    capitals = len(_CAPITAL.findall(text))
    marks = lower.count("!")
    points = sum(lower.count(c) for c in ".,;:?\"'()*#@$%&")
    best = sorted(weights.values(), reverse=True)
    return [
        sum(best[:BEST]),
        best[0] if best else 0.0,
        sum(best) / words,
        math.log1p(strong),
        strong / words,
        float(sum(w >= STRONG for w in best)),
        math.log1p(plain),
        plain / words,
        float(len(insults)),
        math.log1p(hidden),
        hidden / words,
        float(near),
        near / words,
        len(persons) / words,
        capitals / chars,
        marks / words,
        points / chars,
        mixed / words,
        math.log1p(n),
        letters / words,
    ]


def dense_features(lexicon):
    """Features of a column of texts under a broadcast lexicon."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def features(texts: pd.Series) -> pd.Series:
        own = lexicon.value
        return pd.Series([text_features(t, own) for t in texts])

    return features


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, least: int = LEAST) -> Lexicon:
    """Log-odds of the words and beginnings in the texts of ``rows`` (text, label 0 or 1).

    An entry stands in ``least`` toxic texts at least; half a text of each class is added to its counts,
    in the classes' shares. The ``entries`` ones with the most evidence (log-odds times texts) stay.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found: set[str] = set()
                for token in set(_TOKEN.findall(text.lower())):
                    found.update(entries_of(token.strip(_EDGES)))
                (toxic if label else other).update(found)
            names = list(toxic | other)
            yield pd.DataFrame({"entry": names, "toxic": [toxic[e] for e in names], "other": [other[e] for e in names]})

    texts = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    positive, total = int(texts[0] or 0), texts[1]
    if not 0 < positive < total:
        return Lexicon()
    found = rows.select("text", "label").mapInPandas(count, "entry string, toxic bigint, other bigint")
    found = found.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = positive / total
    odds = F.log((F.col("toxic") + 0.5 * share) / (positive + share)) - F.log(
        (F.col("other") + 0.5 * (1 - share)) / (total - positive + (1 - share))
    )
    found = found.where(F.col("toxic") >= least).select("entry", "toxic", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    kept = found.orderBy(F.desc(F.col("odds") * F.col("toxic")), "entry").limit(entries)
    return Lexicon({r["entry"]: r["odds"] for r in kept.collect()})


def held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, HELD_OUT_MODULUS) == 0


class ToxicityModel:
    """Lexicon, trees and calibration, or a constant where the labels do not tell classes apart."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """(row, score): the row as a struct, its score between 0 and 1. Only the text is looked at."""
        rows = docs.select(whole().alias("_text"), F.struct("*").alias("row"))
        if self.trees is None:
            return rows.select("row", F.lit(float(self.constant)).alias("score"))
        small_batches(docs.sparkSession)
        rows = rows.select("row", array_to_vector(dense_features(self.lexicon)("_text")).alias("_features"))
        own = self.trees.transform(rows).withColumn("_own", vector_to_array("_p")[1])
        out = self.calibration.transform(own)
        score = F.col("_calibrated") * (1 - OWN_SHARE) + F.col("_own") * OWN_SHARE
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        return out.select("row", score.alias("score"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = 20, depth: int = 3, seed: int = 7
) -> ToxicityModel:
    """Learn from the labelled rows whose crc32(doc_id) is not divisible by 5."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("double")).alias("label"))
    )
    found = marked.count()
    if found > max_rows:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < 1_000_000 * max_rows // found)
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(PARTS))
    rows = docs.select("doc_id", whole().alias("text")).join(marked, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = materialize(rows.select("text", "label", part.alias("part")), "labelled-texts")
    counts = {(r["kind"], r["label"]): r["count"] for r in rows.groupBy(
        F.when(F.col("part") < LEXICON_PARTS, 0).when(F.col("part") < TREE_PARTS, 1).otherwise(2).alias("kind"), "label"
    ).count().collect()}
    total, toxic = sum(counts.values()), sum(n for (_, label), n in counts.items() if label)
    if any((kind, label) not in counts for kind in (1, 2) for label in (0.0, 1.0)):
        return ToxicityModel(constant=min(UNDECIDED, toxic / total) if total else 0.0)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(rows.where(F.col("part") < LEXICON_PARTS)))
    seen = rows.where(F.col("part") >= LEXICON_PARTS).select("label", "part", dense_features(lexicon)("text").alias("features"))
    seen = materialize(seen, "toxic-features").withColumn("_features", array_to_vector("features"))
    boosting = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3,
        minInstancesPerNode=LEAF_ROWS, seed=seed,
    )
    trees = boosting.setProbabilityCol("_p").fit(seen.where(F.col("part") < TREE_PARTS))
    check = seen.where(F.col("part") >= TREE_PARTS)
    scored = trees.transform(check).withColumn("_own", vector_to_array("_p")[1]).select("label", "_own")
    calibration = IsotonicRegression(featuresCol="_own", labelCol="label", predictionCol="_calibrated").fit(scored)
    return ToxicityModel(lexicon, trees, calibration)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = fit_toxicity(docs, labels, **options).score(docs.select("doc_id", "text"))
    scored = scored.select("row.doc_id", "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return fit_toxicity(docs, labels, **options).score(docs).where("score < 0.5").select("row.*")

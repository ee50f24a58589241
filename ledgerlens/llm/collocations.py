"""Collocations: the best phrases of every language, by best-first branch and bound over prefixes.

A phrase is grown word by word from its first one. Whatever follows, its score is at most
``1000 n / f(first word)``: the cut after that word divides a count by two that are no smaller than it
and than the first word's. First words are therefore the branches, the rarest hold the highest bounds,
and the frontier of a language is the first words not yet expanded whose bound still reaches the score
of its ``top``-th surviving phrase (all of them while there are fewer). Each turn expands the best of
every frontier, in proportion to the text they stand in and twice as much as the turn before; a
language is settled when its frontier is empty, so ties with the last score are in.

Expanding counts phrases level by level below the prefixes that occur often enough, then the rests of
the candidates found and the words before them: a candidate that a longer one contains as often as it
occurs itself has a neighbour, to the left or to the right, that follows it every time.

The corpus is written once as numbers: 64-bit hashes of (language, word), and 0 between pieces and for
words too rare to be in a candidate. Phrases are counted under hashes of these, two of which meet by
chance with a probability of about 1e-19 per pair. Which words, prefixes and rests a pass looks for is
told to tasks as Bloom filters of fixed size; the counts are joined with the exact tables afterwards.

Null text counts as empty, a null language as ``und``; repeated rows count as often as they occur.
Other columns are not looked at. Without candidates, and for an empty table, the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bagminhash import _mix
from ledgerlens.llm.bloom import bloom_filter, may_hold
from ledgerlens.llm.common import UPPER, small_batches, whole
from ledgerlens.session import materialize

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
# A longer candidate with this share (in hundredths) of the count makes the shorter one redundant.
CONTAINED = 100
# Share of a language's text whose first words are expanded in the first turn.
FIRST_SHARE = 1 / 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Signs that end a piece; all of them are read as the first one.
BREAKS = ".,;:!?\n\x0b\x0c\r"
WORDS = r"[^\x20\x09.]+"
TOKENS = WORDS + r"|\.+"
# Words of a row of the corpus; words counted at once, and rows sent back at once.
_ROW = 1_024
_CHUNK = 400_000
_SENT = 65_536


def folded(text: Column) -> Column:
    """Only A-Z lower-cased, and one sign for all that end a piece."""
    return F.translate(text, UPPER + BREAKS[1:], UPPER.lower() + BREAKS[0] * (len(BREAKS) - 1))


def _code_column(lang: str, word: str) -> Column:
    return F.xxhash64(F.concat(F.col(lang), F.lit("\0"), F.col(word)))


def grown(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Codes of phrases with one more word."""
    return _mix(codes * _GOLDEN + words)


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    found = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("word"))
    return found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def code_corpus(rows: DataFrame, frequent) -> DataFrame:
    """(codes) of the texts, cut at breaks into rows of about ``_ROW`` words."""
    def of(token: Column) -> Column:
        return F.when(token.startswith(BREAKS[0]), F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.concat(F.col("lang"), F.lit("\0"), token)))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop = np.zeros(1, dtype=np.int64)
        for batch in batches:
            held = [x for codes in batch["codes"] for x in (codes, stop)]
            if not held:
                continue
            codes = np.concatenate(held).view(np.uint64)
            codes = np.where(may_hold(frequent.value, codes), codes, np.uint64(0))
            # Of zeros in a row one says as much, and a word between two is in no phrase.
            lone = codes != 0
            lone[1:] &= codes[:-1] == 0
            lone[:-1] &= codes[1:] == 0
            codes[lone] = 0
            wanted = codes != 0
            wanted[1:] |= codes[:-1] != 0
            flat = codes[wanted].view(np.int64)
            if len(flat):
                cuts = np.flatnonzero(flat == 0)
                at = np.unique(cuts[np.searchsorted(cuts, np.arange(_ROW, len(flat), _ROW)).clip(max=len(cuts) - 1)])
                yield pd.DataFrame({"codes": pd.Series([p for p in np.split(flat, at) if p.any()], dtype=object)})

    tokens = F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0))
    return rows.select(F.transform(tokens, of).alias("codes")).mapInPandas(keep, "codes array<bigint>")


def _sent(columns: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Columns as frames of ``_SENT`` rows, so that neither side of a task holds all of them once more."""
    for at in range(0, len(next(iter(columns.values()))), _SENT):
        yield pd.DataFrame({k: v[at : at + _SENT].view(np.int64) for k, v in columns.items()})


def _over_chunks(corpus: DataFrame, schema: str, count: Callable[[np.ndarray], Iterator[pd.DataFrame]]) -> DataFrame:
    """``count`` over the corpus, many words at a time; phrases do not cross rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        stop = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for codes in batch["codes"]:
                held += [codes, stop]
                size += len(codes) + 1
                if size > _CHUNK:
                    words, held, size = np.concatenate(held).view(np.uint64), [], 0
                    yield from count(words)
        if held:
            words, held = np.concatenate(held).view(np.uint64), []
            yield from count(words)

    return corpus.mapInPandas(run, schema)


def grow(corpus: DataFrame, size: int, first, prefixes) -> DataFrame:
    """(code, prefix, last, a) of phrases of ``size`` words below the prefixes of the filters."""

    def count(x: np.ndarray) -> Iterator[pd.DataFrame]:
        at = np.flatnonzero((x != 0) & may_hold(first.value, x))
        h = x[at]
        for j in range(1, size):
            if j == size - 1 and prefixes is not None:
                found = may_hold(prefixes.value, h)
                at, h = at[found], h[found]
            on = x[at + j] != 0  # every chunk ends with a break
            at, h = at[on], h[on]
            if j < size - 1:
                h = grown(h, x[at + j])
        codes = grown(h, x[at + size - 1])
        codes, where, n = np.unique(codes, return_index=True, return_counts=True)
        yield from _sent({"code": codes, "prefix": h[where], "last": x[at[where] + size - 1], "a": n.astype(np.uint64)})

    found = _over_chunks(corpus, "code bigint, prefix bigint, last bigint, a bigint", count)
    return found.groupBy("code").agg(F.first("prefix").alias("prefix"), F.first("last").alias("last"), F.sum("a").alias("a"))


def look_up(corpus: DataFrame, wanted, longest: int = LONGEST) -> DataFrame:
    """(code, f, before): how often the wanted phrases of 2 to ``longest`` - 1 words occur, and how often
    at most after the same word."""

    def count(x: np.ndarray) -> Iterator[pd.DataFrame]:
        before = np.concatenate([np.zeros(1, dtype=np.uint64), x[:-1]])
        at = np.flatnonzero(x != 0)
        h = x[at]
        for j in range(1, longest - 1):
            on = x[at + j] != 0
            at, h = at[on], h[on]
            h = grown(h, x[at + j])
            hit = may_hold(wanted.value, h)
            codes, left = h[hit], before[at[hit]]
            _, where, n = np.unique(_mix(codes) + left, return_index=True, return_counts=True)
            yield from _sent({"code": codes[where], "left": left[where], "n": n.astype(np.uint64)})

    pairs = _over_chunks(corpus, "code bigint, left bigint, n bigint", count).groupBy("code", "left").agg(F.sum("n").alias("n"))
    return pairs.groupBy("code").agg(F.sum("n").alias("f"), F.max(F.when(F.col("left") != 0, F.col("n"))).alias("before"))


def _rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(phrase, k, code) of what follows the first k words of a candidate."""
    for batch in batches:
        size = batch["words"].map(len)
        for m, own in batch.groupby(size):
            words = np.stack(own["words"].to_list()).astype(np.int64).view(np.uint64)
            for k in range(1, m):
                h = words[:, k]
                for j in range(k + 1, m):
                    h = grown(h, words[:, j])
                yield pd.DataFrame({"phrase": own["code"].to_numpy(np.int64), "k": k, "code": h.view(np.int64)})


def _dealt(table: DataFrame) -> DataFrame:
    """A table that grows with the corpus, never broadcast: some bytes of a written row are ten times as many in memory."""
    return table.hint("merge")


def _expand(spark: SparkSession, corpus: DataFrame, open_words: DataFrame, words: DataFrame, longest: int, min_count: int) -> DataFrame:
    """Surviving candidates whose first word is open: lang, words, a, l, r, n, score."""

    def told(codes: DataFrame, column: str = "code"):
        return spark.sparkContext.broadcast(bloom_filter(codes.select(column), column))

    first, prefixes = told(open_words), None
    level = open_words.select(
        "lang", "n", "code", F.array("code").alias("words"), F.array().cast("array<bigint>").alias("ls"), F.col("f").alias("a")
    )
    levels = []
    for size in range(2, longest + 1):
        found = grow(corpus, size, first, prefixes).where(F.col("a") >= min_count)
        below = level.select(
            "lang", "n", F.col("code").alias("prefix"), F.col("words").alias("stem"), F.array_append("ls", F.col("a")).alias("ls")
        )
        level = found.join(_dealt(below), "prefix").select(
            "lang", "n", "code", "prefix", F.array_append("stem", F.col("last")).alias("words"), "ls", "a"
        )
        level = materialize(level, f"phrases-{size}")
        levels.append(level)
        prefixes = told(level)
    every = reduce(DataFrame.unionByName, levels)
    after = every.groupBy(F.col("prefix").alias("code")).agg(F.max("a").alias("after"))
    rests = materialize(every.select("code", "words").mapInPandas(_rests, "phrase bigint, k int, code bigint"), "rests")
    wanted = rests.select("code").unionByName(every.where(F.size("words") < longest).select("code"))
    found = materialize(look_up(corpus, told(wanted), longest), "rest-counts")
    counts = found.select("code", F.col("f").alias("r")).unionByName(words.select("code", F.col("f").alias("r")))
    rs = rests.join(_dealt(counts), "code").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("rs"))
    rows = every.join(_dealt(rs.withColumnRenamed("phrase", "code")), "code").join(_dealt(after), "code", "left")
    rows = rows.join(_dealt(found.select("code", "before")), "code", "left")
    longer = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0)))
    rows = rows.where((F.size("words") == longest) | (100 * longer < CONTAINED * F.col("a")))

    def big(c: Column) -> Column:
        return c.cast("decimal(18,0)")

    def cut(l: Column, i: Column) -> Column:
        r = F.col("rs")[i]["r"]
        score = F.call_function("div", big(F.col("a")) * big(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), big(l) * big(r))
        return F.struct(score.alias("score"), (i + 1).alias("k"), l.alias("l"), r.alias("r"))

    lowest = F.array_min(F.transform("ls", cut))
    return rows.select("lang", "n", "code", "words", "a", lowest.alias("cut")).select("lang", "n", "code", "words", "a", "cut.*")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), folded(whole()).alias("text"))
    counted = materialize(count_words(rows), "collocation-words")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.where(F.col("f") >= min_count).join(sizes, "lang")
    words = materialize(
        words.select("lang", "word", "f", "n", _code_column("lang", "word").alias("code"), F.floor(F.log2("f")).alias("size")),
        "frequent-words",
    )
    frequent = spark.sparkContext.broadcast(bloom_filter(words, "code"))
    corpus = materialize(code_corpus(rows, frequent), "coded-corpus")
    # First words that are left, rarest first, in steps of twice the count; the cut of each language is a table.
    left, found, share = words, None, FIRST_SHARE
    while left.head(1):
        mass = left.groupBy("lang", "n", "size").agg(F.sum("f").alias("mass"))
        upto = F.sum("mass").over(Window.partitionBy("lang").orderBy("size"))
        lowest = F.min("size").over(Window.partitionBy("lang"))
        steps = mass.withColumn("upto", upto).withColumn("lowest", lowest)
        steps = steps.where((F.col("upto") <= F.col("n") * share) | (F.col("size") == F.col("lowest"))).select("lang", "size")
        open_words = materialize(left.join(steps, ["lang", "size"]), "open-words")
        grown_now = materialize(_expand(spark, corpus, open_words, words, longest, min_count), "collocations")
        found = grown_now if found is None else found.unionByName(grown_now)
        last = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        settled = found.withColumn("place", last).where(F.col("place") <= top).where(F.col("place") == top)
        settled = settled.select("lang", F.col("score").alias("least"))
        left = left.join(steps, ["lang", "size"], "left_anti").join(settled, "lang", "left")
        bound = F.floor(1000 * F.col("n") / F.col("f")) + 1  # one more, for the rounding of the quotient
        left = materialize(left.where(F.col("least").isNull() | (bound >= F.col("least"))).drop("least"), "frontier")
        share *= 4
    if found is None:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    # Phrases that may be among the first, spelled out.
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    near_top = materialize(found.withColumn("place", place).where(F.col("place") <= top).drop("place"), "near-top")
    spelled = near_top.select("code", F.posexplode("words").alias("at", "word_code"))
    spelled = spelled.join(_dealt(words.select(F.col("code").alias("word_code"), "word")), "word_code").groupBy("code")
    spelled = spelled.agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    phrase = F.array_join(F.transform("parts", lambda p: p["word"]), " ")
    out = near_top.join(spelled, "code").withColumn("phrase", phrase)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

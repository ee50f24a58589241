"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Grams are the beginnings and the ends of words, of every length, each with its place in the word fixed
by the end it is anchored at. A gram that more than ``LIST`` words have is frequent; the dictionary is
pruned to the shortest grams that are not. A word is decomposed into its shortest rare beginning and
its shortest rare end, and what stands between and within them.

An edit leaves everything to its left and right as it was. That bounds, word by word, which grams it
can affect: with the rare end to its right, both words are in the list of that gram; with the rare
beginning to its left, in that one's; and where neither is whole, the parts on both sides are frequent
grams, and their two lists are merged: the words are met under both parts at once. Which of the three
holds depends on the unaffected parts alone, so both words of a near pair choose the same list and no
pair is lost. Lists of one gram hold at most ``LIST`` words; merged lists hold words that agree in all
but one place, at most as many as there are letters. Every pair of a list is verified.

Grams are met by 64-bit hashes, and whether one is frequent is asked of a Bloom filter of fixed size:
a collision or a false answer is the same for both words and costs a comparison, not a pair.

Null texts have no words. Words that are not near any other have ``n_near`` 0 and are their own root.
Repeated rows count as often as they occur; a null ``doc_id`` is the empty text in the choice of edits.
Other columns of the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bagminhash import _mix
from ledgerlens.llm.bloom import bloom_filter, may_hold
from ledgerlens.llm.common import lower_ascii, whole
from ledgerlens.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGED = 97
RATIO = 2
LIST = 64
RUN = r"[A-Za-zÀ-ÿ]+"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xD1B54A32D192ED03)


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts; of one run in ``DAMAGED`` a letter is left out."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(whole()), F.lit(RUN), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat_ws(":", "id", "run"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("size"))
    at = F.col("h") % F.col("size")
    cut = F.concat(F.expr("substring(run, 1, int(h % size))"), F.expr("substring(run, int(h % size) + 2)"))
    word = F.when(F.col("h") % DAMAGED == 0, F.when(at >= 0, cut)).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def anchored_hashes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: which words, and the hashes of their beginnings and ends of 0, 1, .. letters."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        raw = "".join(words[i] for i in at).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, dtype="<u4").reshape(len(at), size).astype(np.uint64)
        out = []
        for start, order in ((_GOLDEN, range(size)), (_END, range(size - 1, -1, -1))):
            h = np.empty((size + 1, len(at)), dtype=np.uint64)
            h[0] = start
            for k, i in enumerate(order):
                h[k + 1] = _mix(h[k] * _GOLDEN + codes[:, i] + np.uint64(1))
            out.append(h.T)
        yield at, out[0], out[1]


def shortest_rare(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Length of the shortest gram of each row that is not frequent; one more than all if there is none."""
    rare = ~may_hold(frequent, hashes)
    rare[:, 0] = False
    return np.where(rare.any(axis=1), rare.argmax(axis=1), hashes.shape[1])


def lists_of(words: list[str], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, key) of every list that a word is in."""
    places, keys = [], []
    for at, begin, end in anchored_hashes(words):
        size = begin.shape[1] - 1
        first, last = shortest_rare(begin, frequent), shortest_rare(end, frequent)
        for shortest, hashes in ((first, begin), (last, end)):
            own = np.flatnonzero(shortest <= size)
            places.append(at[own])
            keys.append(_mix(hashes[own, shortest[own]] + _GOLDEN))
        # Around a letter (its loss or change), and around a gap between letters (one more in the other word).
        for lost in (1, 0):
            for left in range(size + 1 - lost):
                right = size - lost - left
                own = np.flatnonzero((left < first) & (right < last))
                places.append(at[own])
                keys.append(_mix(_mix(begin[own, left]) + end[own, right] * _GOLDEN))
    return np.concatenate(places), np.concatenate(keys)


def near_words(words: DataFrame, longest_list: int = LIST) -> DataFrame:
    """(a, b, n_a, n_b), a < b, of all pairs of words (word, n) that are one edit apart."""
    spark = words.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [h[:, 1:].ravel() for _, *both in anchored_hashes(batch["word"].tolist()) for h in both]
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"gram": grams.view(np.int64), "n": n})

    grams = words.select("word").mapInPandas(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = spark.sparkContext.broadcast(bloom_filter(grams.where(F.col("n") > longest_list), "gram"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                places, keys = lists_of(batch["word"].tolist(), frequent.value)
                yield batch.iloc[places].assign(key=keys.view(np.int64))[["key", "word", "n"]]

    lists = words.select("word", "n").mapInPandas(listed, "key bigint, word string, n bigint")
    left = lists.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = lists.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to; every turn doubles the steps taken."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(on, "root", "left")
        step = step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        roots = step.select("word", "root")
        if not step.where("moved").head(1):
            return roots


def spelling_variants(docs: DataFrame, ratio: int = RATIO, longest_list: int = LIST) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialize(count_words(docs), "spelling-words")
    pairs = near_words(words, longest_list)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.first("n").alias("n"),
        F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("top"),
    )
    good = -F.col("top.less") >= ratio * F.col("n")
    best = best.select(
        "word", "n_near", F.when(good, F.col("top.other")).alias("form"), F.when(good, -F.col("top.less")).alias("form_n")
    )
    best = materialize(best, "near-words")
    roots = follow(best.where("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )

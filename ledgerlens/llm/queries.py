"""The registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bagminhash import near_duplicates
from ledgerlens.llm.bpe import digests
from ledgerlens.llm.collocations import collocations
from ledgerlens.llm.common import UPPER, table
from ledgerlens.llm.digest import compare_edited
from ledgerlens.llm.exact import exact_duplicates
from ledgerlens.llm.html import extract_pages
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.notices import scan_notices
from ledgerlens.llm.pivots import near_vectors
from ledgerlens.llm.pseudonyms import pseudonymise
from ledgerlens.llm.spelling import spelling_variants
from ledgerlens.llm.suffix_tree import score_texts
from ledgerlens.llm.toxicity import score_toxicity
from ledgerlens.session import prepare


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_edited(table(prepare(spark), sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(prepare(spark), sf_dir, "documents"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "kept")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    replaced = F.filter("values", lambda v: v["replaced"])
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(replaced, lambda v: v["kind"]))), ",")
    return out.select(
        "row.doc_id", "text", F.size("values").alias("n_found"), F.size(replaced).alias("n_replaced"), kinds.alias("kinds")
    )


def op6_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(table(prepare(spark), sf_dir, "documents")).drop("spans")


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(prepare(spark), sf_dir, "documents"))


def op8_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(prepare(spark), sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(prepare(spark), sf_dir, "documents"))


def op12_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(prepare(spark), sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(prepare(spark), sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_blocks,
        op2_improbable_digest,
        op3_suffix_tree,
        op4_bagminhash,
        op5_pseudonyms,
        op6_notices,
        op7_fair_mix,
        op8_hash_index,
        op9_word_bpe,
        op10_toxicity,
        op11_gram_variants,
        op12_pivot_index,
        op13_collocations,
    )
}

ORACLES = {
    "op8_hash_index": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op7_fair_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
        c AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, source_size * 2 AS cap,
                     (source_size * 2) / [3, 1, 2][(place - 1) % 3 + 1] AS ratio FROM p),
        l AS (SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget,
                 (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
                  - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
        t AS (SELECT *, CASE WHEN level < ratio THEN (SELECT level FROM l WHERE level < ratio ORDER BY ratio, place LIMIT 1)
                 * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l),
        q AS (SELECT d.*, t.place, t.source_size, t.budget, t.target, row_number() OVER () AS row,
                 sum(d.size) OVER (PARTITION BY t.place ORDER BY turn, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS sent
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT *, (sent + pass * source_size) / target AS finish FROM q, range(2) r(pass) WHERE size > 0 AND target > 0),
        r AS (SELECT *, sum(size) OVER (ORDER BY finish, place, turn, doc_id, pass ROWS UNBOUNDED PRECEDING) AS running FROM k),
        g AS (SELECT row, sum(size) AS taken FROM r WHERE running <= budget GROUP BY row)
        SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
        FROM q LEFT JOIN g USING (row)""",
}

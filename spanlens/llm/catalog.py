"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, fertility, mixing, packing, ranked_search, secrets, simhash, spelling, token_counts, token_files,
    toxicity, warc, weak_labels,
)

#: Shares of all words that the mix aims at.
TARGETS = {"good": 0.94, "low": 0.04, "toxic": 0.02}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)],
        F.sha2(secrets.span_text(of(0, 1, 2)), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(_documents(spark, sf_dir))


def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(_documents(spark, sf_dir), labels(spark, sf_dir), TARGETS)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.quality_scores(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_documents(spark, sf_dir))
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_token_counts, op3_best_fit_packing, op4_secret_scans, op5_token_files, op6_mixing_weights,
    op7_simhash_near_dedup, op8_warc, op9_quality_classifier, op10_exact_dedup,
    op11_ranked_search, op12_toxicity, op13_spelling_variants,
)}

SQL = {
    "op8_warc": """
        WITH t AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), o AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS owner
            FROM t
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN owner <> page_id THEN owner END AS refers_to
        FROM o
    """,
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op11_ranked_search": rf"""
        WITH words AS (
            SELECT row_number() OVER () AS place, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{ranked_search.UPPER}', '{ranked_search.LOWER}'),
                                      '{ranked_search.TERM}') AS terms
            FROM documents
        ), lengths AS (
            SELECT count(*) AS docs_in_all, sum(len(terms))::BIGINT AS terms_in_all FROM words WHERE len(terms) > 0
        ), found AS (
            SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM words) GROUP BY ALL
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), '{ranked_search.UPPER}', '{ranked_search.LOWER}'), '{ranked_search.TERM}')) AS term
            FROM benchmark
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * docs_in_all + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM found, lengths GROUP BY term, docs_in_all
        ), sums AS (
            SELECT item_id, place, sum(w * ((1000000000 * tf) // (1000 * tf
                   + 8 * (100 - 90 + (90 * len(terms) * docs_in_all) // terms_in_all))))::BIGINT AS score
            FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN words USING (place), lengths
            GROUP BY item_id, place
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank,
               doc_id, score
        FROM sums JOIN words USING (place) WHERE score > 0 QUALIFY rank <= {ranked_search.TOP}
    """,
}

"""Queries on training data, and the SQL of those that have any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import leaks, lookalikes, mixing, mojibake, residue, survivors
from trawl.runtime import table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf_dir, n) for n in ("files", "index_roots", "meta"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_files(*_tables(spark, sf_dir)).select("hash_hex", "keep_id")


def p1_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.fused_files(*_tables(spark, sf_dir))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.fused_values(*_tables(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_looking(table(spark, sf_dir, "files"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_classes(table(spark, sf_dir, "files"))


def p3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", lookalikes.one_form("name").alias("name"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged_files(table(spark, sf_dir, "documents_text"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(table(spark, sf_dir, "documents_text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.without_leaks(docs, table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf_dir, "documents"))


def p8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_lines(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_fused": p1_fused,
        "p1_values": p1_values,
        "p3_found": p3_found,
        "p3_names": p3_names,
        "p3_classes": p3_classes,
        "p4_found": p4_found,
        "p4_restored": p4_restored,
        "p6_found": p6_found,
        "p6_clean": p6_clean,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_lines": p8_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH until AS (SELECT max(CAST(value AS BIGINT)) AS u FROM meta WHERE key = 'last_full_index'),
            g AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM files WHERE hash IS NOT NULL AND size > 0),
            r AS (SELECT g.*, (SELECT max_by(trust, length(root)) FROM index_roots
                               WHERE starts_with(g.path, root || '/')) AS trust FROM g WHERE n >= 2)
            SELECT lower(hex(hash)) AS hash_hex, id AS keep_id FROM (
                SELECT *, row_number() OVER (PARTITION BY hash ORDER BY
                    (mime IS NOT NULL)::INT + coalesce(content_state = 1, false)::INT DESC, trust DESC NULLS LAST,
                    CASE WHEN mtime BETWEEN 1 AND (SELECT u FROM until) THEN mtime ELSE 0 END DESC, id) AS rn FROM r)
            WHERE rn = 1
        """,
    }

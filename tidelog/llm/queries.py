"""The ten operators as named queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_ts import op1_transport_stream as op

    return op(table(spark, sf_dir, "documents"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import op2_kneser_ney as op

    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_near import op3_projection_passes as op

    return op(table(spark, sf_dir, "embeddings"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import op4_weak_supervision as op

    return op(table(spark, sf_dir, "documents"))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import op5_water_filling as op

    return op(table(spark, sf_dir, "documents"))


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import op6_vector_best_fit as op

    return op(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import op7_simhash as op

    return op(table(spark, sf_dir, "documents"))


def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitplane import op8_bit_planes as op

    return op(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import op9_line_dedup as op

    return op(table(spark, sf_dir, "documents"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import op10_compression_quality as op

    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_transport_stream, op2_kneser_ney, op3_projection_passes, op4_weak_supervision, op5_water_filling, op6_vector_best_fit, op7_simhash, op8_bit_planes, op9_line_dedup, op10_compression_quality)}


#: Op 5 by one sort per source; the operator finds the same border without it.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CAST(list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)) AS DOUBLE) AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
t AS (SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS part FROM g),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.part, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(chr(31), 'mix-1', coalesce(CAST(d.doc_id AS VARCHAR), ''), CAST(d.size AS VARCHAR))), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, greatest(0, least(size, part - before)) AS extra FROM x)
SELECT doc_id, size, source_size, target, CAST(whole * size + extra AS BIGINT) AS taken, CAST(whole + CASE WHEN 2 * extra >= greatest(size, 1) THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_water_filling": MIX_SQL}

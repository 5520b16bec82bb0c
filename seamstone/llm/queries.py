"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamstone.llm import documented, handwritten, leakage, packing, residue, secrets, syntax, term_frequency
from seamstone.sources.checkpoints import cut_lineage
from seamstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    counts = term_frequency.term_counts(files, ["imports", "functions"])
    return term_frequency.mark_terms(counts, files).select("field_name", "term", "n_total", "n_files", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.unparsed_files(table(spark, sf_dir, "source_files")).select("file_id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.unparsed_rates(table(spark, sf_dir, "source_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "source_files")).select("file_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "repo_contexts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.documented_functions(table(spark, sf_dir, "code_symbols"), table(spark, sf_dir, "source_files")).select("symbol_id")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.documented_functions(table(spark, sf_dir, "code_symbols"), table(spark, sf_dir, "source_files"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = packing.token_sizes(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, table(spark, sf_dir, "pack_limits"))


def p7_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut_lineage(packing.token_sizes(table(spark, sf_dir, "documents")))
    limits = table(spark, sf_dir, "pack_limits")
    return packing.packing_integrity(packing.pack(sizes, limits), sizes, limits)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = residue.text_residue(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rated.where(rated.kind.isNotNull()).select("doc_id")


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_pack": p7_pack, "p7_integrity": p7_integrity, "p8_found": p8_found, "p9_found": p9_found}

ORACLES: dict[str, str] = {
    "p2_found": r"""
WITH e AS (
  SELECT 'imports' AS field_name, file_id, unnest(imports) AS raw FROM source_files
  UNION ALL
  SELECT 'functions', file_id, unnest(functions) FROM source_files
), t AS (
  SELECT field_name, file_id, trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(34) || chr(39) || ';') AS term FROM e
), c AS (
  SELECT field_name, term, count(*) AS n_total, count(DISTINCT file_id) AS n_files
  FROM t WHERE term IS NOT NULL AND term <> '' GROUP BY 1, 2
)
SELECT field_name, term, n_total, n_files,
  CASE WHEN n_files <= 2 THEN 'rare'
       WHEN n_files * 100 > 5 * (SELECT count(*) FROM source_files) THEN 'common' ELSE 'useful' END AS mark
FROM c
""",
    "p7_integrity": """
SELECT limit_id, (SELECT count(*) FROM documents) AS items, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS incomplete, true AS well_filled FROM pack_limits WHERE capacity_tokens > 0
""",
    "p8_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(CASE WHEN contains(text, chr(10)) THEN text[instr(text, chr(10)) + 1:] ELSE '' END), '[\p{L}\p{N}_]+') AS w FROM eval_items),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT item_id, n, pos, array_to_string(w[pos:pos + 5], ' ') AS s FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 4)) AS pos FROM i)),
t AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 4), lambda p: array_to_string(w[p:p + 5], ' '))) AS s FROM d),
c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(pos, pos + 6)) AS p FROM s JOIN t USING (s))
SELECT doc_id, item_id FROM c GROUP BY doc_id, item_id, n HAVING count(*) * 2 >= n
""",
}

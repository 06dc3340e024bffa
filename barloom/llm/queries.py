"""Queries p4, p6, p7 and p8 over the test tables, with SQL where SQL can state their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.copies import collapse_copies, find_copies
from barloom.llm.leakage import leaked_spans, remove_leaks
from barloom.llm.packing import fill_report, pack_documents
from barloom.llm.toxicity import fit_model, rates_by, score_documents
from barloom.sources import table

_COPY_RULE = {"row_id": "row_id", "ordered": ["title", "raw_hash"], "unordered": ["source"], "required": ["raw_hash"]}


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    found = find_copies(table(spark, root, "stock_event_store"), **_COPY_RULE)
    return found.select(F.col("first_id").alias("first_row_id"), F.col("copy_id").alias("copy_row_id"))


def p4_events(spark: SparkSession, root: str) -> DataFrame:
    """One row per event with its number of deliveries."""
    return collapse_copies(table(spark, root, "stock_event_store"), keep=["symbol", "title"], **_COPY_RULE)


_P4 = """
WITH k AS (
  SELECT row_id, symbol, title, raw_hash IS NULL AS alone,
         CASE WHEN raw_hash IS NULL THEN 'r' || row_id ELSE concat_ws('|',
           regexp_replace(lower(upper(title)), '[^\\p{L}\\p{N}]+', '', 'g'), regexp_replace(lower(upper(raw_hash)), '[^\\p{L}\\p{N}]+', '', 'g'),
           array_to_string(list_sort(regexp_extract_all(lower(upper(source)), '[\\p{L}\\p{N}]+')), '')) END AS key
  FROM stock_event_store),
g AS (SELECT *, min(row_id) OVER (PARTITION BY key) AS first_row_id, count(*) OVER (PARTITION BY key) AS copies FROM k)
"""
P4_FOUND = _P4 + "SELECT first_row_id, row_id AS copy_row_id FROM g WHERE row_id <> first_row_id"
P4_EVENTS = _P4 + "SELECT row_id, symbol, title, copies FROM g WHERE row_id = first_row_id"


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Which document, or piece of one, lies in which container of each capacity."""
    return pack_documents(table(spark, root, "documents"), table(spark, root, "pack_capacity"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers used and filled share per capacity."""
    return fill_report(p6_containers(spark, root), table(spark, root, "pack_capacity"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_spans(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its leaked spans cut out."""
    documents = table(spark, root, "documents")
    return remove_leaks(documents, leaked_spans(documents, table(spark, root, "eval_items")))


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its score, the probability of each kind of content, and whether it should be reviewed."""
    documents = table(spark, root, "documents")
    return score_documents(documents, fit_model(documents, table(spark, root, "doc_labels")), keep=["source"])


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    model = fit_model(documents, table(spark, root, "doc_labels"), by_kind=False)
    return score_documents(documents, model).where("flagged").select("doc_id")


def p8_source_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of documents to review per source."""
    return rates_by(p8_scores(spark, root), "source")


P7_FOUND = """
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
w AS (SELECT kind, id, regexp_extract_all(regexp_replace(lower(text), '(\\p{Han})', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS words FROM t),
g AS (SELECT DISTINCT kind, id, unnest(list_transform(generate_series(1, len(words) - 15), lambda i: array_to_string(words[i:i + 15], ' '))) AS gram FROM w WHERE len(words) >= 16)
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.kind = 'd' AND b.kind = 'i' AND a.gram = b.gram
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_events, p6_containers, p6_fill, p7_found, p7_cleaned, p8_found, p8_scores, p8_source_rates)}
SQL = {"p4_found": P4_FOUND, "p4_events": P4_EVENTS, "p7_found": P7_FOUND}

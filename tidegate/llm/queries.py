"""The queries of the ten operators and of the pipeline over them, each with its SQL where SQL can
express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import bpe, decontam, jaccard, lattice, linecrf, pii, pq, records, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_url_filter": urls.op2_url_filter,
    "op3_embedding_dedup": pq.op3_embedding_dedup,
    "op4_pii": pii.op4_pii,
    "op5_quality": linecrf.op5_quality,
    "op6_bpe": bpe.op6_bpe,
    "op7_lattice_lm": lattice.op7_lattice_lm,
    "op8_token_records": records.op8_token_records,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "url_rules": urls.url_rules,
}

LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("text")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i : i + 2]) END) AS gram FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * overlap >= 90 * (x.n + y.n - overlap)
), either AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, b AS other FROM either UNION SELECT r.doc_id, e.b FROM reached r JOIN either e ON e.a = r.other
), lowest AS (
  SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest l ON l.doc_id = d.doc_id
"""


def _rule_sql() -> str:
    def fits(rule: str) -> str:
        host, slash, tail = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + tail}')"

    longest = sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in longest)
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, {LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict FROM parts
"""


#: What SQL can say: the join in whole, and of the URL filter all that its rules decide.
ORACLE_SQL: dict[str, str] = {"op10_ngram_jaccard": JACCARD, "url_rules": _rule_sql()}

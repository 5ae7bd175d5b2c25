"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .chat_format import ORACLE as _PREFERENCES


def tokenizer_path() -> str:
    """The tokenizer file on this machine; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import classify

    return classify(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import classes

    return classes(table(spark, sf_dir, "documents"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import preferences

    return preferences(table(spark, sf_dir, "conversations"))


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no images; each embedding is drawn as a picture, and every tenth picture has an edited copy."""
    from .media import copies, pictures

    return copies(pictures(table(spark, sf_dir, "embeddings")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of odd ids are history: they are scanned into a ledger first, and the report of all rows scans only blobs that the ledger lacks."""
    from .secret_scan import report_in_steps

    docs = table(spark, sf_dir, "documents")
    return report_in_steps(docs, [docs.where("doc_id % 2 <> 0")])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import report

    return report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_ngram_join, op3_preferences, op4_packing, op5_language_id, op6_image_copies, op7_line_dedup, op8_secret_scan, op9_license_scan, op10_html_extract)}

_WORDS10 = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


_MORE = (
    "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----",
    "(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})",
    "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s, length(m[i]) AS n
FROM (SELECT doc_id, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g FROM d)) WHERE length(g[i]) >= {least}"""


ORACLES = {
    "op3_preferences": _PREFERENCES,
    "op8_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 24)}
 UNION ALL {_spans("pem", 3, _MORE[0], 0, 1)} UNION ALL {_spans("prefixed", 4, _MORE[1], 0, 1)} UNION ALL {_spans("jwt", 5, _MORE[2], 0, 1)}),
b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE rank = {i}) AS c{i}" for i in range(6))}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank) AS t,
 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS u FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(c{i}, 0) AS n_{k}" for i, k in enumerate(("assign", "access", "hex", "pem", "prefixed", "jwt")))}, sha256(coalesce(u, '')) AS base_sha256, coalesce(t, '') AS spans FROM d LEFT JOIN b USING (doc_id)
""",
    "op1_decontaminate": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS10.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, m, array_to_string(w[k + 1:k + m], ' ') AS p FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(len(w) - least(10, len(w)) + 1)) AS k FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_WORDS10.format(t="coalesce(text, '')")} AS w FROM documents),
occ AS (SELECT doc_id, item, k, m FROM (SELECT doc_id, m, k, array_to_string(w[k + 1:k + m], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(greatest(len(w) - m + 1, 0))) AS k FROM dw, (SELECT DISTINCT m FROM win))) JOIN win USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
}

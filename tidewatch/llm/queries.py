"""The registered query of each operator, over its whole table with production parameters, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, host_quality, language, licences, mixing, pii, quality_fm, simhash, toxicity
from .common import table

#: Where the vocabulary files are; a parameter of the queries that need one.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.of_documents(table(spark, sf_dir, "documents")))


def op1_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.of_pages(table(spark, sf_dir, "pages")), "page_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scanned(docs, licences.fit(docs))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.verdicts(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), path or vocabulary_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.scored(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op4_pii that SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256")


def op9_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op9_fingerprints that SQL can express."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op10_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op10_mixing that SQL can express."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op1_language_pages": op1_language_pages,
    "op2_toxicity": op2_toxicity,
    "op3_licences": op3_licences,
    "op4_pii": op4_pii,
    "op5_host_quality": op5_host_quality,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "op4_pii_base": op4_pii_base,
    "op9_edits": op9_edits,
    "op10_targets": op10_targets,
}

#: DuckDB's expressions for a text's words and for what is no word.
_WORDS, _BLANK = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')", r"[\x20\x09-\x0D]"


def _host_sql() -> str:
    """op5: measures, base rules, rates shrunk by the method of moments, odds and verdict."""
    names = ["any", *host_quality.RULES]
    prior = ", ".join(
        f"least(greatest(sum(f_{x}) / sum(n), 1e-6), 1 - 1e-6) AS m_{x}, (sum(f_{x} * f_{x} / n) - sum(f_{x}) * sum(f_{x}) / sum(n)) / sum(n) AS v_{x}" for x in names
    )
    spread = lambda x: f"m_{x} * (1 - m_{x})"
    strength = ", ".join(f"least(greatest({spread(x)} / greatest(v_{x} - {spread(x)} * h / total, {spread(x)} * 1e-4) - 1, 1.0), 1e4) AS s_{x}" for x in names)
    rates = ", ".join(f"(f_{x} + m_{x} * s_{x}) / (n + s_{x}) AS r_{x}" for x in names)
    odds = "".join(f" * CASE WHEN x_{x} = 1 THEN {host_quality.EVIDENCE[x]} * r_{x} / m_{x} ELSE 1.0 END" for x in host_quality.RULES)
    flags = ", ".join(f"coalesce(({rule})::INT, 0) AS x_{x}" for x, rule in host_quality.RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
each AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
threes AS (SELECT rid, i, a, lead(a, 1) OVER own AS b, lead(a, 2) OVER own AS c FROM each WINDOW own AS (PARTITION BY rid ORDER BY i)),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM threes WHERE c IS NOT NULL),
again AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE k > 1) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM d JOIN lines USING (rid) LEFT JOIN again USING (rid)),
f AS (SELECT *, n_words < {host_quality.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {flags} FROM m),
g AS (SELECT *, greatest(base_failed::INT, {", ".join(f"x_{x}" for x in host_quality.RULES)}) AS x_any FROM f),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"sum(x_{x}) AS f_{x}" for x in names)} FROM g GROUP BY source),
prior AS (SELECT sum(n) AS total, count(*) AS h, {prior} FROM hosts),
fitted AS (SELECT *, {strength} FROM prior),
rated AS (SELECT source, {rates}, {", ".join(f"m_{x}" for x in names)} FROM hosts CROSS JOIN fitted),
odds AS (SELECT g.*, r_any, {" + ".join(f"x_{x}" for x in host_quality.RULES)} AS n_failed, round(r_any / (1 - r_any){odds}, 6) AS o FROM g JOIN rated ON g.source IS NOT DISTINCT FROM rated.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_failed = 0 OR o <= {host_quality.ODDS}) AS kept,
  n_failed::INT AS n_failed, round(r_any, 6) AS host_rate, CASE WHEN n_failed > 0 THEN o END AS odds
FROM odds"""


def _pii_sql() -> str:
    """op4's base spans: a kind's matches and what lies between them give the positions."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: (ascii(digits[-i]) - 48) * (2 - i % 2) - CASE WHEN i % 2 = 0 AND ascii(digits[-i]) > 52 THEN 9 ELSE 0 END)) % 10 = 0"
    good = {"email": "true", "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(nullif(ltrim(x, '0'), ''), '0')[:3]::INT <= 255))", "card": f"length(digits) BETWEEN 12 AND 19 AND {luhn}", "phone": "length(digits) BETWEEN 9 AND 15"}
    parts = " UNION ALL ".join(f"SELECT rid, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM d" for rank, (kind, p) in enumerate(patterns.items()))
    cases = " ".join(f"WHEN '{kind}' THEN {test}" for kind, test in good.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({parts}),
each AS (SELECT rid, kind, rank, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM found WHERE len(hits) > 0),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS "end", regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM each),
kept AS (SELECT rid, kind, rank, ("end" - length(hit))::BIGINT AS start, "end"::BIGINT AS "end" FROM placed WHERE CASE kind {cases} END),
joined AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)}, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in patterns)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN joined USING (rid)"""


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after, (length(text) // 2)::BIGINT AS half FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(left(text, length(text) - half) || left(after, half)) AS edited_sha256 FROM n"""


def _targets_sql() -> str:
    """op10's targets: sources are full from the one of the least size for its weight on; the level is that of the fewest full ones that leaves no other over its limit."""
    share, most = mixing.SHARE, mixing.MOST
    return rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {most} * source_size / weight, source) AS k FROM s),
c AS (
  SELECT k, {most}::DOUBLE * source_size / weight AS fills, coalesce(sum({most}::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, sum(source_size) OVER () AS whole
  FROM o),
l AS (SELECT ({share}::DOUBLE * whole - gone) / open_weight AS level FROM c WHERE ({share}::DOUBLE * whole - gone) / open_weight < fills ORDER BY k LIMIT 1)
SELECT doc_id, size, source_size, least({most}::DOUBLE * source_size, weight * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""


#: The others can't be said in SQL, nor can the other columns of op4, op9 and op10: tests/llm hold them against brute force.
ORACLES: dict[str, str] = {"op5_host_quality": _host_sql(), "op4_pii_base": _pii_sql(), "op9_edits": EDITS_SQL, "op10_targets": _targets_sql()}

"""Queries over lines of files, units and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.functions import scalars as S
from diffloom.operators import gate, units
from diffloom.plans.registry import SQL, query, r6
from diffloom.session import table
from diffloom.sources import text

_UNIT_LINES = """
    u AS (SELECT DISTINCT unit_id, repo, path, language_id, start_line, source_lines FROM review_units),
    l AS (SELECT unit_id, repo, path, language_id, start_line + generate_subscripts(source_lines, 1) - 1 AS line_no, unnest(source_lines) AS line FROM u)
"""
_FILE_LINES = r"""
    s AS (SELECT file_id, CASE WHEN content = '' THEN [] ELSE string_split_regex(content, '\r?\n') END AS a FROM changed_files WHERE content IS NOT NULL),
    t AS (SELECT file_id, CASE WHEN len(a) > 0 AND a[-1] = '' THEN a[:-2] ELSE a END AS a FROM s),
    f AS (SELECT file_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM t)
"""


def unit_lines(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, repo, path, language_id, line_no, line) of every unit; units sent again count once."""
    one = table(spark, d, "review_units").select("unit_id", "repo", "path", "language_id", "start_line", "source_lines").dropDuplicates(["unit_id"])
    return text.exploded_lines(one, "source_lines", "unit_id", "repo", "path", "language_id", start=F.col("start_line"))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, line_no, line) of every changed file with text."""
    return text.exploded_lines(table(spark, d, "changed_files"), "content", "file_id")


@query("line_split", f"WITH {_FILE_LINES} SELECT file_id, line_no::INT AS line_no, line FROM f")
def line_split(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every changed file."""
    return file_lines(spark, d)


@query("unit_lines", f"WITH {_UNIT_LINES} SELECT unit_id, line_no::INT AS line_no, line FROM l")
def unit_line_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every review unit."""
    return unit_lines(spark, d).select("unit_id", "line_no", "line")


@query("diff_parse")
def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all unified diffs among the labelled sources."""
    return text.diff_lines(table(spark, d, "eval_cases").where("source LIKE 'diff --git %'"), "case_id", "source")


@query("diff_added")
def diff_added(spark: SparkSession, d: str) -> DataFrame:
    """The lines those diffs add."""
    return text.added_lines(table(spark, d, "eval_cases").where("source LIKE 'diff --git %'"), "case_id", "source")


@query(
    "file_gate",
    r"""
    WITH g AS (
        SELECT field_name, string_agg('^' || replace(replace(replace(replace(replace(regexp_replace(pattern, '([.])', '[.]', 'g'), '**/', '<A>'), '**', '<B>'), '*', '[^/]*'), '<A>', '(.*/)?'), '<B>', '.*') || '$', '|') AS re
        FROM gate_options GROUP BY field_name),
    f AS (SELECT *, replace(path, chr(92), '/') AS p FROM changed_files),
    m AS (
        SELECT f.*, coalesce(regexp_matches(p, (SELECT re FROM g WHERE field_name = 'secret_globs'), 'i'), false) OR (regexp_matches(p, '(^|/)\.env($|\.)', 'i') AND NOT regexp_matches(p, '\.env\.(example|template|sample|dist)$', 'i')) AS secret,
            coalesce(regexp_matches(p, (SELECT re FROM g WHERE field_name = 'exclude'), 'i'), false) AS excluded,
            coalesce(regexp_matches(p, (SELECT string_agg(re, '|') FROM g WHERE field_name IN ('default_globs', 'generated_globs', 'test_globs')), 'i'), false) AS standard
        FROM f)
    SELECT file_id, CASE WHEN is_binary OR status = 'binary' THEN 'binary' WHEN status = 'submodule' THEN 'submodule' WHEN secret THEN 'secret_path' WHEN excluded THEN 'user_exclude'
        WHEN language_id IS NULL THEN 'unsupported' WHEN standard THEN 'default_path' WHEN status = 'deleted' THEN 'deleted' WHEN status = 'mode' AND coalesce(added_count, 0) = 0 THEN 'mode'
        WHEN coalesce(added_count, 0) > 1500 THEN 'too_large' WHEN coalesce(added_count, 0) = 0 THEN 'no_added_lines' END AS reason
    FROM m
    """,
)
def file_gate(spark: SparkSession, d: str) -> DataFrame:
    """Why each changed file is skipped; null for review."""
    return gate.gated(table(spark, d, "changed_files"), table(spark, d, "gate_options")).select("file_id", "reason")


@query(
    "gate_agreement",
    f"""
    WITH now AS ({SQL["file_gate"]}),
    l AS (SELECT file_id, arg_max({{'d': decision, 'r': reason}}, {{'n': run_no, 't': decided_at, 'i': decision_id}}) AS r FROM gate_decisions GROUP BY file_id)
    SELECT now.reason, l.r.d AS recorded, l.r.r AS recorded_reason, count(*) AS files FROM now LEFT JOIN l USING (file_id) GROUP BY ALL
    """,
)
def gate_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The gate against the last recorded decision of each file."""
    last = table(spark, d, "gate_decisions").groupBy("file_id").agg(F.max_by(F.struct("decision", "reason"), F.struct("run_no", "decided_at", "decision_id")).alias("r"))
    now = file_gate(spark, d).join(last, "file_id", "left")
    return now.groupBy("reason", F.col("r.decision").alias("recorded"), F.col("r.reason").alias("recorded_reason")).agg(F.count(F.lit(1)).alias("files"))


def _case_sql(key: str, table_: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


@query(
    "lang_detect",
    rf"""
    WITH b AS (SELECT file_id, string_split(replace(path, chr(92), '/'), '/')[-1] AS name, substr(coalesce(content, ''), 1, 2048) AS head FROM changed_files)
    SELECT file_id, coalesce({_case_sql('name', gate.BY_NAME)}, {_case_sql("lower(regexp_extract(name, '([.][^.]+)$', 1))", gate.BY_EXTENSION)},
        {_case_sql("regexp_extract(head, '^#![ ]*(?:[^ ]*/)?(?:env +)?(?:[^ ]*/)?([A-Za-z]+[0-9]*)', 1)", gate.BY_SHEBANG)},
        CASE WHEN regexp_matches(head, '^\s*<!DOCTYPE html|^\s*<html') THEN 'html' WHEN regexp_matches(head, '(?m)^package \w+\s*$') THEN 'go' WHEN regexp_matches(head, '^\s*\{{\s*"') THEN 'json' END) AS language FROM b
    """,
)
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    """The detected language of every changed file."""
    return table(spark, d, "changed_files").select("file_id", gate.detected_language(F.col("path"), F.col("content")).alias("language"))


@query(
    "html_blocks",
    r"""
    WITH b AS (SELECT case_id, source, unnest(['head', 'body', 'title']) AS tag FROM eval_cases),
    m AS (SELECT case_id, tag, regexp_extract(source, '(?is)^(.*?<' || tag || '[^>]*>)(.*?)</' || tag || '>', 1) AS pre, regexp_extract(source, '(?is)^(.*?<' || tag || '[^>]*>)(.*?)</' || tag || '>', 2) AS body
          FROM b WHERE regexp_matches(source, '(?is)<' || tag || '[^>]*>.*?</' || tag || '>'))
    SELECT case_id, tag, (length(pre) - length(replace(pre, chr(10), '')) + 1)::INT AS start_line, (length(pre) - length(replace(pre, chr(10), '')) + length(body) - length(replace(body, chr(10), '')) + 1)::INT AS end_line FROM m
    """,
)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """P5: line ranges of blocks in marked-up sources."""
    return units.blocks(table(spark, d, "eval_cases"), "case_id", "source", ("head", "body", "title"))


@query(
    "unit_windows",
    """
    WITH n AS (SELECT DISTINCT file_id, len(list_distinct(added_line_numbers)) AS n FROM changed_files WHERE added_line_numbers IS NOT NULL),
    k AS (SELECT file_id, n, unnest(generate_series(0, CASE WHEN n <= 20 THEN 0 ELSE ceil((n - 5) / 15.0)::INT - 1 END)) AS k FROM n WHERE n > 0)
    SELECT file_id, k::INT AS chunk, (k * 15 + 1)::INT AS first, least(k * 15 + 20, n)::INT AS last FROM k
    """,
)
def unit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of up to 20 added lines of each file, five shared."""
    n = F.size(F.array_distinct("added_line_numbers"))
    return table(spark, d, "changed_files").where("added_line_numbers IS NOT NULL").select("file_id", F.explode(units.window_spans(n, 20, 5)).alias("w")).select("file_id", "w.*")


@query(
    "added_runs",
    """
    WITH x AS (SELECT DISTINCT file_id, unnest(added_line_numbers) AS line FROM changed_files),
    i AS (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS g FROM x WHERE line IS NOT NULL)
    SELECT file_id, min(line) AS run_start, max(line) AS run_end, count(*)::INT AS added FROM i GROUP BY file_id, g
    """,
)
def added_runs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive added lines of each file."""
    return units.added_runs(table(spark, d, "changed_files"))


@query(
    "unit_merge",
    f"""
    WITH RECURSIVE a AS ({SQL["added_runs"]}),
    o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY run_start) AS n FROM a),
    m AS (SELECT file_id, n, run_start AS s, run_end AS e, added AS k, 0 AS unit_no FROM o WHERE n = 1
        UNION ALL SELECT o.file_id, o.n, CASE WHEN o.run_start - m.e <= 6 AND m.k + o.added <= 120 THEN m.s ELSE o.run_start END, o.run_end,
            CASE WHEN o.run_start - m.e <= 6 AND m.k + o.added <= 120 THEN m.k + o.added ELSE o.added END, CASE WHEN o.run_start - m.e <= 6 AND m.k + o.added <= 120 THEN m.unit_no ELSE m.unit_no + 1 END
        FROM m JOIN o ON o.file_id = m.file_id AND o.n = m.n + 1)
    SELECT file_id, unit_no::INT AS unit_no, min(s) AS start_line, max(e) AS end_line, max(k)::INT AS added FROM m GROUP BY file_id, unit_no
    """,
)
def unit_merge(spark: SparkSession, d: str) -> DataFrame:
    """Those runs merged over gaps of up to six lines, up to 120 added lines."""
    return units.merged_units(units.added_runs(table(spark, d, "changed_files")))


@query(
    "unit_scope",
    rf"""
    WITH {_UNIT_LINES}, k AS (SELECT l.*, line_no - start_line + 1 AS i, length(regexp_extract(line, '^(\s*)', 1)) AS w FROM l JOIN (SELECT DISTINCT unit_id, start_line FROM u) s USING (unit_id) WHERE trim(coalesce(line, '')) <> ''),
    o AS (SELECT unit_id, max(i) AS last, arg_max(w, i) AS wide FROM k GROUP BY unit_id),
    h AS (SELECT k.unit_id, max(i) AS scope_line FROM k JOIN o USING (unit_id) WHERE i < last AND i >= last - {units.SCOPE_REACH} AND w < wide
        AND CASE language_id {" ".join(f"WHEN '{k}' THEN regexp_matches(line, '{v}')" for k, v in units.SIGNATURES.items())} ELSE regexp_matches(line, '{units.BRACED}') END GROUP BY k.unit_id)
    SELECT DISTINCT review_units.unit_id, scope_line::INT AS scope_line FROM review_units LEFT JOIN h USING (unit_id)
    """,
)
def unit_scope(spark: SparkSession, d: str) -> DataFrame:
    """The line that encloses each unit's last line."""
    return units.with_scope(table(spark, d, "review_units").dropDuplicates(["unit_id"])).select("unit_id", "scope_line")


@query(
    "imports",
    rf"""
    WITH {_FILE_LINES}
    SELECT file_id, line_no::INT AS line_no, trim(line) AS line FROM f WHERE regexp_matches(trim(line), '^(?:import|from|package|using|use) |require\(')
    QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) <= 40
    """,
)
def import_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first import lines of each changed file."""
    return units.imports(file_lines(spark, d), "file_id")


@query(
    "snippets",
    f"""
    WITH {_UNIT_LINES}
    SELECT unit_id, line_no::INT AS line_no, md5(string_agg(line, chr(10)) OVER (PARTITION BY unit_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) AS snippet FROM l
    """,
)
def snippet_rows(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each line's snippet of four lines."""
    return units.snippets(unit_lines(spark, d), "unit_id").select("unit_id", "line_no", F.md5("snippet").alias("snippet"))


@query(
    "suppress",
    rf"""
    WITH {_UNIT_LINES},
    m AS (SELECT unit_id, line_no, CASE WHEN contains(line, 'edge case:') THEN coalesce(nullif(regexp_extract(line, 'edge case:\s+(\S+)', 1), ''), '*') END AS here FROM l),
    p AS (SELECT unit_id, line_no, coalesce(here, lag(here) OVER (PARTITION BY unit_id ORDER BY line_no)) AS suppresses FROM m)
    SELECT unit_id, line_no::INT AS line_no, suppresses FROM p WHERE suppresses IS NOT NULL
    """,
)
def suppress(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a marker on them or the line before speaks for."""
    return units.suppressed(unit_lines(spark, d), "unit_id", "edge case:").where("suppresses IS NOT NULL").select("unit_id", "line_no", "suppresses")


@query("token_estimate", "SELECT doc_id, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 3.5))::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """estimated tokens of each document."""
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query(
    "fingerprints",
    r"""
    WITH {l} SELECT unit_id, line_no::INT AS line_no, sha1('line|' || trim(regexp_replace(path, '\s+', ' ', 'g')) || '|' || trim(regexp_replace(line, '[ \t\n\f\r]+', ' ', 'g'))) AS fingerprint,
        'f_' || substr(sha1('line|' || trim(regexp_replace(path, '\s+', ' ', 'g')) || '|' || trim(regexp_replace(line, '[ \t\n\f\r]+', ' ', 'g'))), 1, 8) AS id FROM l
    """.replace("{l}", _UNIT_LINES),
)
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """a fingerprint and a short id per line."""
    fp = S.fingerprint(F.lit("line"), F.col("path"), F.col("line"))
    return unit_lines(spark, d).select("unit_id", "line_no", fp.alias("fingerprint"), F.concat(F.lit("f_"), F.substring(fp, 1, 8)).alias("id"))


_SQL_REDACT = "text"
for _k, _p in S.REDACTED:
    _SQL_REDACT = f"regexp_replace({_SQL_REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '[REDACTED:{_k}]', 'g')"


@query("redact", f"SELECT doc_id, {_SQL_REDACT} AS text FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    """documents with tokens of known formats replaced."""
    return table(spark, d, "documents").select("doc_id", S.redact_text(F.col("text")).alias("text"))


@query(
    "secret_kinds",
    " UNION ALL ".join(f"SELECT unit_id, line_no::INT AS line_no, '{k}' AS kind FROM l WHERE regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in S.REDACTED).join(("WITH " + _UNIT_LINES, "")),
)
def secret_kinds(spark: SparkSession, d: str) -> DataFrame:
    """kinds of tokens per line."""
    return unit_lines(spark, d).select("unit_id", "line_no", F.explode(S.secret_kinds(F.col("line"))).alias("kind"))


@query("injection", "SELECT doc_id, CASE WHEN regexp_matches(text, '{}', 'i') THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END AS p FROM documents".format("|".join(f"(?:{p})" for p in S.INJECTIONS)))
def injection(spark: SparkSession, d: str) -> DataFrame:
    """How likely a document talks to the reviewer."""
    return table(spark, d, "documents").select("doc_id", S.injection_probability(F.col("text")).alias("p"))


@query(
    "ascii_share",
    r"""
    WITH b AS (SELECT doc_id, regexp_replace(text, '[ \t\n\v\f\r]', '', 'g') AS b FROM documents)
    SELECT doc_id, {} AS share FROM b
    """.format(r6(r"CASE WHEN length(b) > 0 THEN length(regexp_replace(b, '[^\x00-\x7F]', '', 'g')) / length(b)::DOUBLE WHEN b IS NULL THEN 1.0 ELSE 1.0 END")),
)
def ascii_share(spark: SparkSession, d: str) -> DataFrame:
    """share of ASCII among the visible characters."""
    return table(spark, d, "documents").select("doc_id", S.round_to(S.ascii_share(F.col("text"))).alias("share"))


@query(
    "path_parts",
    r"""
    WITH b AS (SELECT file_id, string_split(replace(path, chr(92), '/'), '/')[-1] AS name FROM changed_files)
    SELECT file_id, name, lower(regexp_extract(name, '(\.[^.]+)$', 1)) AS ext, split_part(name, '.', 1) AS stem FROM b
    """,
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """F16: name, extension and stem of each path."""
    p = F.col("path")
    return table(spark, d, "changed_files").select("file_id", S.basename(p).alias("name"), S.extension(p).alias("ext"), S.stem(p).alias("stem"))

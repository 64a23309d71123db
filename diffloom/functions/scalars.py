"""Scalar Column functions: rounding, tokens, severity, fingerprints, redaction, paths, templates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

SEVERITIES = ("low", "medium", "high", "critical")

# Token formats that the line redactor replaces, in this order.
REDACTED = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("openai-key", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("connection-string", r"(?i)\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s'\"]+"),
)
# Phrases that talk to the reviewer instead of the program.
INJECTIONS = (
    r"ignore\s+(?:all|any|previous|this)\s+(?:instructions|rules|reviews?|findings?)",
    r"do\s+not\s+(?:flag|report|review)",
    r"this\s+(?:code\s+)?is\s+safe",
    r"ai\s+reviewer",
    r"please\s+(?:mark|treat|consider)[^\n]{0,60}(?:safe|benign)",
    r"not\s+a\s+(?:vulnerability|bug|security\s+issue)",
)
# Probabilities of a hit and of no hit.
HIT, MISS = 0.9, 0.05


def round_to(x: Column, digits: int = 6) -> Column:
    """Round half up, as floor(x * 10^digits + 0.5); null and non-finite values give 0."""
    unit = float(10**digits)
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.when(finite, F.floor(x * F.lit(unit) + F.lit(0.5)) / F.lit(unit)).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """At least 1, else the UTF-8 bytes divided by 3.5, rounded up; a null text counts as empty."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(3.5))).cast("long")


def severity_rank(severity: Column) -> Column:
    """0 to 3; unknown and null severities are 0."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(1)) - 1, F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    """The severity of a rank, clamped to 0..3."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.least(F.greatest(rank, F.lit(0)), F.lit(3)) + 1).cast("int"))


def clamp_severity(severity: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """The severity raised to ``low`` and lowered to ``high``; a null bound is no bound."""
    rank = severity_rank(severity)
    if low is not None:
        rank = F.greatest(rank, F.when(low.isNotNull(), severity_rank(low)).otherwise(F.lit(0)))
    if high is not None:
        rank = F.least(rank, F.when(high.isNotNull(), severity_rank(high)).otherwise(F.lit(3)))
    return severity_name(rank)


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z) with z held within -30 and 30."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))


def guarded(p: Column, guards: Column) -> Column:
    """p times (1 - guard)^weight over an array of structs (p, weight), rounded to 6 places; null p counts as 0."""
    start = F.coalesce(p, F.lit(0.0))
    return round_to(F.aggregate(F.coalesce(guards, F.array()), start, lambda acc, g: acc * F.pow(F.lit(1.0) - F.coalesce(g["p"], F.lit(0.0)), g["weight"])))


def fused(p: Column, guards: Column, bias: Column | float, main: Column | float, guard: Column | float) -> Column:
    """The logistic form: sigmoid(bias + main p + guard mean(guards)), rounded to 6 places; no guards have the mean 0."""
    g = F.coalesce(guards, F.array())
    mean = F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["p"], F.lit(0.0))) / F.size(g)).otherwise(F.lit(0.0))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return round_to(sigmoid(as_column(bias) + as_column(main) * F.coalesce(p, F.lit(0.0)) + as_column(guard) * mean))


def scored_severity(score: Column, confidence: Column, levels: Sequence[str] = SEVERITIES, default: str = "medium") -> Column:
    """The level of a rounded score, held within the levels; ``default`` where the confidence is below 0.4 or either is null."""
    place = F.least(F.greatest(F.floor(score + 0.5), F.lit(0)), F.lit(len(levels) - 1)).cast("int")
    return F.when((confidence >= 0.4) & score.isNotNull(), F.element_at(F.array(*map(F.lit, levels)), place + 1)).otherwise(F.lit(default))


def alert_severity(score: Column, level: Column) -> Column:
    """high from a score of 2 on, low up to 0, medium between; without a score by the level of the alert."""
    by_level = F.when(level == "error", "high").when(level.isin("note", "none"), "low").otherwise("medium")
    return F.when(score >= 2, "high").when(score <= 0, "low").when(score.isNotNull(), "medium").otherwise(by_level)


def truncated(text: Column, n: int) -> Column:
    """The text, or its first ``n`` - 1 characters and an ellipsis if it is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def escaped(text: Column) -> Column:
    """The text as a regular expression that matches it literally."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def fenced_json(text: Column, schema: str) -> Column:
    """A JSON object that may stand in a code fence, as ``schema``; null if it doesn't parse."""
    inner = F.regexp_extract(F.trim(text), r"(?is)^```(?:json)?\s*(.*?)```$", 1)
    return F.from_json(F.when(inner != "", F.trim(inner)).otherwise(F.trim(text)), schema)


def squash(text: Column) -> Column:
    """Trimmed text with runs of white space made one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the parts joined by a bar, with white space squashed; null parts are empty."""
    return F.sha1(F.concat_ws("|", *(squash(F.coalesce(p, F.lit(""))) for p in parts)))


def redact_text(text: Column) -> Column:
    """The text with tokens of known formats replaced by [REDACTED:kind]."""
    return reduce(lambda t, kv: F.regexp_replace(t, kv[1], f"[REDACTED:{kv[0]}]"), REDACTED, text)


# Names whose quoted values are secrets, and values that only stand for one.
SECRET_NAMES = r"\b(password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\b"
STAND_INS = r"example|changeme|placeholder|redacted|dummy|fake|todo|test|password|secret|token|your[-_].*|x{4,}|<[^>]+>"


def redact_assignments(text: Column) -> Column:
    """The text with quoted values of secret-named variables replaced by [REDACTED:secret].

    Values under eight characters, stand-ins, values with "example" and already redacted ones stay.
    """
    one = lambda t, q: F.regexp_replace(t, rf"(?i){SECRET_NAMES}(\s*[:=]\s*){q}(?!(?:{STAND_INS}){q})(?![^'\"]*(?:example|\[REDACTED:))[^'\"]{{8,}}{q}", f"$1$2{q}[REDACTED:secret]{q}")
    return one(one(text, '"'), "'")


def secret_kinds(text: Column) -> Column:
    """Array of the kinds of tokens in the text."""
    kinds = F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in REDACTED))
    return F.filter(kinds, lambda k: k.isNotNull())


def injection_probability(text: Column) -> Column:
    """HIT if the text holds a phrase that talks to the reviewer, else MISS; null is MISS."""
    return F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS)), F.lit(HIT)).otherwise(F.lit(MISS))


def ascii_share(text: Column) -> Column:
    """Share of ASCII among the characters that aren't white space; 1 for a text without any."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(bare) > 0, F.length(F.regexp_replace(bare, r"[^\x00-\x7F]", "")) / F.length(bare)).otherwise(F.lit(1.0))


def slashed(path: Column) -> Column:
    """The path with forward slashes."""
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.substring_index(slashed(path), "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def indent(line: Column) -> Column:
    """Leading white-space characters."""
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def marker(fp: Column, tag: str = "fingerprint") -> Column:
    """A fingerprint as a hidden comment."""
    return F.concat(F.lit(f"<!-- {tag}:"), fp, F.lit(" -->"))


def marked(body: Column, tag: str = "fingerprint") -> Column:
    """The distinct fingerprints in a body, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(rf"<!-- {tag}:([0-9a-f]+) -->"), 1)))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template compiled to a Column: ``{{name}}`` is a value, ``{{#if name}}..{{/if}}`` stands if it isn't empty.

    Unknown and null values are empty. The template is taken apart on the driver; rows only concatenate.
    """

    def value(name: str) -> Column:
        return F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit("")

    def build(text: str) -> list[Column]:
        parts: list[Column] = []
        while m := re.search(r"\{\{#if (\w+)\}\}(.*?)\{\{/if\}\}|\{\{(\w+)\}\}", text, re.S):
            parts.append(F.lit(text[: m.start()]))
            parts.append(value(m[3]) if m[3] else F.when(value(m[1]) != "", F.concat(*build(m[2]))).otherwise(F.lit("")))
            text = text[m.end() :]
        return [*parts, F.lit(text)]

    return F.concat(*build(template))


def template_names(template: str) -> list[str]:
    """Names a template uses, in order of first use."""
    return list(dict.fromkeys(m[0] or m[1] for m in re.findall(r"\{\{#if (\w+)\}\}|\{\{(\w+)\}\}", template)))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found; no pattern and null text give false."""
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)

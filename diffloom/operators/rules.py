"""Declarative rules compiled to Column expressions and matched against lines; findings, bands and duplicates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffloom.functions.scalars import HIT, MISS, SEVERITIES, fingerprint, round_to, severity_rank
from diffloom.operators.gate import glob_regex

#: Probability of a rule without a hit, and of one that always applies.
NO_HIT, ALWAYS = 0.1, 0.2
# Report and uncertain thresholds by profile.
PROFILES = {"chill": (0.85, 0.70), "balanced": (0.75, 0.55), "assertive": (0.60, 0.40)}
MAX_RULES_PER_UNIT = 40


@dataclass(frozen=True)
class Rule:
    """One rule: where it applies, what it looks for, what speaks against it, and how bad it is.

    ``trigger`` is regex (the pattern, on added lines), always, or removed (units of files with deleted lines). ``hint``
    and ``anti`` are patterns on a unit's added lines that make a rule without pattern likely or unlikely.
    ``thresholds`` (report, uncertain) take the place of the profile's.
    """

    id: str
    pattern: str
    category: str
    severity: str
    languages: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    guard: str | None = None
    guard_weight: float = 1.0
    priority: float | None = None
    message: str = field(default="")
    frameworks: tuple[str, ...] = ()
    min_added: int = 0
    trigger: str = "regex"
    hint: str | None = None
    anti: str | None = None
    thresholds: tuple[float, float] | None = None

    @property
    def urgency(self) -> float:
        """The explicit priority, or the rank of the severity."""
        return SEVERITIES.index(self.severity) if self.priority is None else self.priority


#: A pack over the languages of the tables. Patterns are in the common part of Java's and RE2's syntax.
PACK = (
    Rule("async.unawaited-call", r"^\s*(?:client|store|queue)\.\w+\(", "correctness", "medium", ("typescript", "javascript", "python", "csharp"), guard=r"await|return"),
    Rule("crypto.weak-hash", r"(?i)\b(?:md5|sha1)\(", "security", "medium", guard=r"(?i)checksum|etag"),
    Rule("error.broad-catch", r"catch \((?:RuntimeException|Exception|Throwable)\b|except Exception|except:", "reliability", "medium", ("java", "python", "csharp")),
    Rule("error.ignored-result", r"^\s*_\s*(?:,\s*_\s*)?:?= ", "reliability", "medium", ("go",)),
    Rule("error.panic", r"\.unwrap\(\)|panic!?\(", "reliability", "high", ("rust", "go")),
    Rule("exec.dynamic-code", r"\b(?:eval|exec)\(", "security", "critical"),
    Rule("io.unclosed", r"\bopen\(", "reliability", "low", ("python",), guard=r"with open\("),
    Rule("limit.magic-number", r"limit(?:: \w+)? = \d+", "maintainability", "low"),
    Rule("log.left-in", r"console\.\w+\(|debugger|System\.out\.print|fmt\.Print", "maintainability", "low"),
    Rule("net.cleartext", r"http://", "security", "medium", guard=r"localhost|127\.0\.0\.1"),
    Rule("null.unchecked-get", r"\.get\(key\)", "correctness", "medium", ("java", "typescript"), guard=r"!= null|\?\."),
    Rule("secret.assigned", r"(?i)(?:password|passwd|secret|token|api_?key)\w*\"?\s*[:=]+\s*[\"'][^\"']{8,}", "security", "critical", guard=r"(?i)placeholder|your-|xxxx|todo|replace_me|\$\{|env:|vault", guard_weight=2.0),
    Rule("sql.joined-text", r"(?i)select .+ from .+[\"'] ?\+", "security", "high"),
    Rule("state.mutable-default", r"def \w+\(.*=(?:\[\]|\{\})", "correctness", "medium", ("python",)),
    Rule("text.todo", r"\b(?:TODO|FIXME|XXX)\b", "maintainability", "low", guard=r"[A-Z]+-\d+|#\d+"),
    Rule("thread.static-state", r"static (?:final )?int\[\]", "concurrency", "low", ("java",), paths=("**/src/main/**",)),
)


#: A pack for what single lines don't tell: patterns over line ends, frameworks, sizes, and rules without a pattern.
WIDE_PACK = (
    Rule("flow.wrapped-callback", r"=>\s*\{\s*\n\s*(?:return|await)\b", "maintainability", "low", ("typescript", "javascript")),
    Rule("http.unbounded-query", r"limit(?:: \w+)? = \d{2,}", "reliability", "medium", frameworks=("express", "gin", "spring"), priority=2.5),
    Rule("review.large-change", "", "maintainability", "low", trigger="always", min_added=60, anti=r"\bgenerated\b", hint=r"\b(?:TODO|FIXME)\b"),
    Rule("removed.behaviour", "", "correctness", "high", trigger="removed", languages=("java", "go", "python"), thresholds=(0.95, 0.5)),
    Rule("removed.test", "", "reliability", "medium", trigger="removed", paths=("**/tests/**", "**/src/test/**"), anti=r"\bdef test_", priority=3.0),
)


def read_pack(entries: list[dict]) -> tuple[Rule, ...]:
    """Rules from the entries of a pack file; entries without an id or with an unknown trigger raise ValueError."""
    rules = []
    for e in entries:
        applies, trigger, severity = e.get("applies", {}), e.get("trigger", {}), e.get("severity", {})
        kind = trigger.get("kind", "regex")
        if not e.get("id") or kind not in ("regex", "always", "removed"):
            raise ValueError(f"not a rule: {e.get('id')!r}, trigger {kind!r}")
        if e.get("deprecated"):
            continue
        guards, limits, mock = e.get("guards") or [{}], e.get("thresholds", {}), e.get("mock", {})
        flags = "(?i)" if "i" in trigger.get("flags", "") else ""
        rules.append(
            Rule(
                e["id"], flags + trigger.get("pattern", "") if kind == "regex" else "", e.get("category", "correctness"), severity.get("max") or (severity.get("map") or [severity.get("default", "medium")])[-1],
                tuple(applies.get("languages", ())), tuple(applies.get("paths", ())), guards[0].get("pattern"), float(guards[0].get("weight", 1.0)), e.get("priority"), e.get("message", ""),
                tuple(applies.get("frameworks", ())), int(applies.get("minAddedLines", 0)), kind, mock.get("positive"), mock.get("negative"), (limits["report"], limits["uncertain"]) if limits else None,
            )
        )
    return tuple(rules)


def lint(rules: tuple[Rule, ...] = PACK) -> list[tuple[str, str]]:
    """(rule id, issue): duplicate ids, bad patterns, unknown severities, identifiers that don't read group.name."""
    issues, seen = [], set()
    for r in rules:
        if r.id in seen:
            issues.append((r.id, "duplicate id"))
        seen.add(r.id)
        for p in filter(None, (r.pattern, r.guard)):
            try:
                re.compile(p)
            except re.error as x:
                issues.append((r.id, f"bad pattern: {x}"))
        if r.severity not in ("low", "medium", "high", "critical"):
            issues.append((r.id, "unknown severity"))
        if not re.fullmatch(r"[a-z0-9]+(?:\.[a-z0-9-]+)+", r.id):
            issues.append((r.id, "bad id"))
    return issues


def _text(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _applies(r: Rule) -> list[str]:
    """SQL conditions on language, path, frameworks and number of added lines of the unit a rule is tried on."""
    parts = []
    if r.min_added:
        parts.append(f"n_added >= {r.min_added}")
    if r.languages:
        parts.append(f"lower(language_id) IN ({', '.join(map(_text, r.languages))})")
    if r.frameworks:
        parts.append(f"arrays_overlap(frameworks, array({', '.join(map(_text, r.frameworks))}))")
    if r.paths:
        globs = "|".join(f"(?i)^{glob_regex(g)}$" for g in r.paths)
        parts.append(f"translate(path, {_text(chr(92))}, '/') RLIKE {_text(globs)}")
    return parts


def _hit(r: Rule, marked: bool = False) -> str:
    """SQL for whether a rule applies to and hits a line, and no marker turns it off there (or, ``marked``, one does)."""
    parts = [*_applies(r), f"line RLIKE {_text(r.pattern)}"]
    off = f"(off_here IN ('*', {_text(r.id)}) OR off_before IN ('*', {_text(r.id)}))"
    return "(" + " AND ".join([*parts, off if marked else f"NOT {off}"]) + ")"


def _outcome(r: Rule, p: float = HIT) -> str:
    """SQL for what a hit is worth. Both outcomes of the guard are worked out beforehand."""
    worth = lambda g: f"{math.floor(p * (1 - g) ** r.guard_weight * 1e6 + 0.5) / 1e6!r}D"
    if r.guard:
        guarded = f"line RLIKE {_text(r.guard)}"
        guard, eff = f"if({guarded}, {HIT}D, {MISS}D)", f"if({guarded}, {worth(HIT)}, {worth(MISS)})"
    else:
        guard, eff = "0D", worth(0.0)
    return f"named_struct('rule_id', {_text(r.id)}, 'category', {_text(r.category)}, 'severity', {_text(r.severity)}, 'p', {p}D, 'guard_p', {guard}, 'p_eff', {eff})"


MARKER = "review-ignore"


def prepared(units: DataFrame, *keep: str, marker: str = MARKER) -> DataFrame:
    """(keep.., language_id, path, frameworks, n_added, added): units with their added lines, in order.

    ``added`` has structs (line_no, line, off_here, off_before): the rule id, or '*' for all, that a marker on the line
    or the line before it turns off. Added line numbers that are null, repeated or outside the unit count as none.
    """
    mark = lambda c: F.when(F.contains(c, F.lit(marker)), F.coalesce(F.nullif(F.regexp_extract(c, rf"{re.escape(marker)}\s+(\S+)", 1), F.lit("")), F.lit("*")))
    inside = F.array_sort(F.array_distinct(F.filter("added_line_numbers", lambda n: (n >= F.col("start_line")) & (n < F.col("start_line") + F.size("source_lines")))))
    at = lambda n: F.get("source_lines", n - F.col("start_line"))
    none = F.lit("")
    line = lambda n: F.struct(n.alias("line_no"), at(n).alias("line"), F.coalesce(mark(at(n)), none).alias("off_here"), F.coalesce(mark(at(n - 1)), none).alias("off_before"))
    added = F.coalesce(F.transform(inside, line), F.array().cast("array<struct<line_no:int,line:string,off_here:string,off_before:string>>"))
    df = units.where("source_lines IS NOT NULL AND start_line IS NOT NULL")
    return df.select(*keep, "language_id", "path", F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"), F.size(added).alias("n_added"), added.alias("added"))


def added_lines(units: DataFrame, *keep: str) -> DataFrame:
    """One row per added line of ``prepared`` units."""
    return units.select(*keep, "language_id", "path", "frameworks", "n_added", F.explode("added").alias("a")).select(*keep, "language_id", "path", "frameworks", "n_added", "a.*")


def rule_matches(lines: DataFrame, *keep: str, rules: tuple[Rule, ...] = PACK, marked: bool = False) -> DataFrame:
    """(keep.., line_no, rule_id, category, severity, p, guard_p, p_eff): one row per added line and rule that hits it.

    All rules are one projection over the lines: no join and no Python, whatever their number. ``lines`` are those of
    ``added_lines``; null lines hit nothing. A rule turned off by a marker doesn't hit; with ``marked``, only such rules
    are given.
    """
    rules = tuple(r for r in rules if r.trigger == "regex")
    # the filter is compiled code and leaves few lines; only those are looked at once more to tell which rules hit
    some = lines.where(" OR ".join(_hit(r, marked) for r in rules))
    each = ", ".join(f"CASE WHEN {_hit(r, marked)} THEN {_outcome(r)} END" for r in rules)
    return some.select(*keep, "line_no", F.expr(f"explode(array({each}))").alias("m")).where("m IS NOT NULL").select(*keep, "line_no", "m.*")


def pool_matches(units: DataFrame, *keep: str, rules: tuple[Rule, ...] = PACK) -> DataFrame:
    """(keep.., line_no, rule_id, category, severity, p, guard_p, p_eff): rules that hit only over line ends.

    A rule none of whose lines hits is tried on a ``prepared`` unit's added lines as one text; the hit lies on the line
    it begins on, unless a marker turns it off there. Only patterns that can match a line end are tried.
    """
    spanning = [r for r in rules if r.trigger == "regex" and re.search(r"\\[sWDn]|\[\^|\(\?s", r.pattern)]
    some = units.withColumn("line", F.array_join(F.transform("added", lambda a: F.coalesce(a["line"], F.lit(""))), "\n"))
    tried = lambda r: " AND ".join([*_applies(r), f"line RLIKE {_text(r.pattern)}", f"NOT exists(added, a -> a.line RLIKE {_text(r.pattern)})"])
    where = lambda r: f"element_at(added, 1 + length(left(line, regexp_instr(line, {_text(r.pattern)}) - 1)) - length(replace(left(line, regexp_instr(line, {_text(r.pattern)}) - 1), '\\n', '')))"
    each = ", ".join(f"CASE WHEN {tried(r)} THEN named_struct('at', {where(r)}, 'm', {_outcome(r)}) END" for r in spanning)
    if not each:
        return rule_matches(added_lines(units.limit(0), *keep), *keep, rules=rules)
    hit = some.where(" OR ".join(f"({' AND '.join([*_applies(r), f'line RLIKE {_text(r.pattern)}'])})" for r in spanning)).select(*keep, F.expr(f"explode(array({each}))").alias("h")).where("h IS NOT NULL")
    here = hit.where("NOT (h.at.off_here IN ('*', h.m.rule_id) OR h.at.off_before IN ('*', h.m.rule_id))")
    return here.select(*keep, F.col("h.at.line_no").alias("line_no"), "h.m.*")


def unit_triggers(units: DataFrame, *keep: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(keep.., rule_id, category, severity, p, guard_p, p_eff): the rules always and removed of ``prepared`` units.

    ``units`` also have ``deleted`` (number of deleted lines of their file). A marker on any added line turns a rule off.
    The probability is that of an unlikely rule where ``anti`` is found in the added lines, of a hit where ``hint`` is or
    where lines are removed, and otherwise that of a rule that always applies.
    """
    some = units.withColumn("line", F.array_join(F.transform("added", lambda a: F.coalesce(a["line"], F.lit(""))), "\n"))
    each = []
    for r in (r for r in rules if r.trigger != "regex"):
        off = f"exists(added, a -> a.off_here IN ('*', {_text(r.id)}) OR a.off_before IN ('*', {_text(r.id)}))"
        when = " AND ".join([*_applies(r), *(["deleted > 0"] if r.trigger == "removed" else []), f"NOT {off}"])
        worth = [(f"line RLIKE {_text(r.anti)}", NO_HIT)] if r.anti else []
        worth += [(f"line RLIKE {_text(r.hint)}", HIT)] if r.hint else []
        rest = HIT if r.trigger == "removed" else ALWAYS
        cases = "".join(f"WHEN {c} THEN {_outcome(r, p)} " for c, p in worth)
        each.append(f"CASE WHEN {when} THEN {f'CASE {cases}ELSE {_outcome(r, rest)} END' if cases else _outcome(r, rest)} END")
    return some.select(*keep, F.expr(f"explode(array({', '.join(each)}))").alias("m")).where("m IS NOT NULL").select(*keep, "m.*")


def own_thresholds(rules: tuple[Rule, ...], profile: str = "balanced") -> Column:
    """A map rule id -> struct (report, uncertain) of the rules that have thresholds of their own."""
    own = [x for r in rules if r.thresholds for x in (F.lit(r.id), F.struct(F.lit(r.thresholds[0]).alias("report"), F.lit(r.thresholds[1]).alias("uncertain")))]
    return F.create_map(*own) if own else F.create_map(F.lit(""), F.struct(F.lit(PROFILES[profile][0]).alias("report"), F.lit(PROFILES[profile][1]).alias("uncertain")))


def rule_band(p: Column, rule_id: Column, rules: tuple[Rule, ...], profile: str = "balanced") -> Column:
    """report, uncertain or drop, by the rule's own thresholds, else the profile's."""
    own = F.try_element_at(own_thresholds(rules, profile), rule_id)
    report, uncertain = (F.coalesce(own[k], F.lit(v)) for k, v in zip(("report", "uncertain"), PROFILES[profile]))
    return F.when(p >= report, "report").when(p >= uncertain, "uncertain").otherwise("drop")


def urgent_rules(matches: DataFrame, key: str, rules: tuple[Rule, ...], k: int = MAX_RULES_PER_UNIT) -> DataFrame:
    """(key, rule_id, rank, truncated): the ``k`` most urgent rules of each unit by priority and id; the rest is counted.

    A rule's explicit priority comes before that by its severity.
    """
    priority = F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r.id), F.lit(float(r.urgency))))), F.col("rule_id"))
    whole = Window.partitionBy(key)
    per = matches.select(key, "rule_id").distinct().withColumn("_p", priority)
    ranked = per.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("_p"), "rule_id"))).withColumn("truncated", F.greatest(F.count(F.lit(1)).over(whole) - k, F.lit(0)))
    return ranked.where(F.col("rank") <= k).select(key, "rule_id", "rank", "truncated")


def band(p: Column, profile: str = "balanced") -> Column:
    """report, uncertain or drop, by the profile's thresholds."""
    report, uncertain = PROFILES[profile]
    return F.when(p >= report, "report").when(p >= uncertain, "uncertain").otherwise("drop")


def top_rules(matches: DataFrame, key: str, k: int = MAX_RULES_PER_UNIT) -> DataFrame:
    """(key, rule_id, rank, truncated): the ``k`` most urgent rules of each unit, by severity and id; the rest is counted.

    Rank and count share one window partition, so there is one shuffle after the counts per rule.
    """
    per = matches.groupBy(key, "rule_id").agg(F.max(severity_rank(F.col("severity"))).alias("_s"))
    whole = Window.partitionBy(key)
    ranked = per.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("_s"), "rule_id"))).withColumn("truncated", F.greatest(F.count(F.lit(1)).over(whole) - k, F.lit(0)))
    return ranked.where(F.col("rank") <= k).select(key, "rule_id", "rank", "truncated")


def findings(matches: DataFrame, *keys: str, profile: str = "balanced") -> DataFrame:
    """Matches at or above the uncertain threshold, one per (keys, line, category), with the ids of those it beat.

    ``keys`` name the file. The best has the largest p_eff times (severity rank + 1), then the smallest rule id. Units
    that overlap find the same line twice; it counts once. One shuffle serves both the distinct rules and the ranking.
    """
    place = [*keys, "line_no", "category"]
    kept = matches.where(F.col("p_eff") >= PROFILES[profile][1]).repartition(*place)
    one = kept.groupBy(*place, "rule_id", "severity").agg(F.max("p_eff").alias("p_eff"))
    w = Window.partitionBy(*place).orderBy(F.desc(round_to(F.col("p_eff") * (severity_rank(F.col("severity")) + 1))), "rule_id")
    related = F.collect_list("rule_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = one.withColumn("_n", F.row_number().over(w)).withColumn("_all", related).where("_n = 1")
    fp = fingerprint(F.col("rule_id"), F.col(keys[-1]), F.col("line_no").cast("string"))
    beaten = F.array_join(F.slice("_all", F.lit(2), F.size("_all")), ",")
    return best.select(*place, "rule_id", "severity", "p_eff", band(F.col("p_eff"), profile).alias("band"), beaten.alias("related"), fp.alias("fingerprint"))


def ordered(found: DataFrame, *keys: str, limit: int) -> DataFrame:
    """The first ``limit`` findings with their ``place``: severity and p_eff descending, then path, line, rule, the rest.

    The limit is taken before the places are given, so only that many rows meet in one task.
    """
    by = (F.desc(severity_rank(F.col("severity"))), F.desc("p_eff"), keys[-1], "line_no", "rule_id", "category", *keys[:-1])
    return found.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)))

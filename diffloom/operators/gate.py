"""File gate and language detection: ordered first-match chains over changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diffloom.functions.scalars import any_match, basename, extension, slashed

MAX_ADDED_PER_FILE = 1500
# Extension -> language, file name -> language, interpreter -> language.
BY_EXTENSION = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".js": "javascript", ".mjs": "javascript", ".jsx": "javascript", ".vue": "vue", ".py": "python", ".pyi": "python", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "csharp", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".properties": "properties"}
BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile", "Cargo.lock": "toml", "go.mod": "go"}
BY_SHEBANG = {"python": "python", "python3": "python", "node": "javascript", "deno": "typescript", "bash": "shell", "sh": "shell"}


def glob_regex(glob: str) -> str:
    """A glob as a regular expression without anchors: ``**`` spans folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-" else "\\" + glob[i]), i + 1
    return out


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether the path matches any glob; case and the kind of slash are ignored; null paths match none."""
    return any_match(slashed(path), [f"(?i)^{glob_regex(g)}$" for g in globs])


def glob_lists(options: DataFrame) -> dict[str, list[str]]:
    """field_name -> globs, from the table of options: configuration of fixed size, which the plan is built from."""
    out: dict[str, list[str]] = {}
    for r in options.select("field_name", "pos", "pattern").distinct().orderBy("field_name", "pos").collect():
        out.setdefault(r["field_name"], []).append(r["pattern"])
    return out


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def shebang(head: Column) -> Column:
    """The interpreter a text's first line names, or null."""
    return F.nullif(F.regexp_extract(head, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?([A-Za-z]+[0-9]*)", 1), F.lit(""))


def detected_language(path: Column, head: Column) -> Column:
    """The language by file name, else extension, else interpreter, else how the text begins; else null."""
    start = F.substring(F.coalesce(head, F.lit("")), 1, 2048)
    sniffed = F.when(start.rlike(r"^\s*<!DOCTYPE html|^\s*<html"), "html").when(start.rlike(r"(?m)^package \w+\s*$"), "go").when(start.rlike(r"^\s*\{\s*\""), "json")
    return F.coalesce(_lookup(BY_NAME, basename(path)), _lookup(BY_EXTENSION, extension(path)), _lookup(BY_SHEBANG, shebang(start)), sniffed)


def gated(files: DataFrame, options: DataFrame, include: list[str] | None = None, max_added: int = MAX_ADDED_PER_FILE) -> DataFrame:
    """``files`` with ``reason`` and ``decision``: the first of an ordered list of reasons to skip, else review.

    ``include`` globs override only "unsupported" and "default_path". Null paths match no glob; a null added_count is 0.
    """
    g = glob_lists(options)
    path = F.col("path")
    env = slashed(path).rlike(r"(?i)(^|/)\.env($|\.)") & ~slashed(path).rlike(r"(?i)\.env\.(example|template|sample|dist)$")
    included = matches_globs(path, include or [])
    default = matches_globs(path, g.get("default_globs", []) + g.get("generated_globs", []) + g.get("test_globs", []))
    added = F.coalesce("added_count", F.lit(0))
    reason = (
        F.when(F.col("is_binary") | (F.col("status") == "binary"), "binary")
        .when(F.col("status") == "submodule", "submodule")
        .when(matches_globs(path, g.get("secret_globs", [])) | F.coalesce(env, F.lit(False)), "secret_path")
        .when(matches_globs(path, g.get("exclude", [])), "user_exclude")
        .when(~included & F.col("language_id").isNull(), "unsupported")
        .when(~included & default, "default_path")
        .when(F.col("status") == "deleted", "deleted")
        .when((F.col("status") == "mode") & (added == 0), "mode")
        .when(added > max_added, "too_large")
        .when(added == 0, "no_added_lines")
    )
    return files.withColumn("reason", reason).withColumn("decision", F.when(reason.isNull(), "review").otherwise("skip"))

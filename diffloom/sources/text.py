"""Sources of lines: texts, folders of files, unified diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Files above this many bytes are left out of a folder scan.
MAX_FILE_BYTES = 2_000_000
# Folders a scan leaves out.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "coverage", "target", "vendor")


def source_lines(text: Column) -> Column:
    """Array of a text's lines: the empty text has none, a last line end adds none, carriage returns are dropped."""
    lines = F.split(text, "\r?\n")
    short = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(short)


def exploded_lines(df: DataFrame, text: str, *keep: str, start: Column | None = None) -> DataFrame:
    """(keep.., line_no, line): one row per line of ``text``, a text or an array of lines; null texts give none."""
    lines = F.col(text) if df.schema[text].dataType.typeName() == "array" else source_lines(F.col(text))
    out = df.select(*keep, (start if start is not None else F.lit(1)).alias("_first"), F.posexplode(lines).alias("_pos", "line"))
    return out.select(*keep, (F.col("_first") + F.col("_pos")).cast("int").alias("line_no"), "line")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): text files below ``folder``, all lines counting as added; binary and oversized files are left out.

    Folders are skipped by their names below ``folder``, whatever lies above it.
    """
    skipped = "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS)
    root = re.sub(r"^\w+:/+", "/", folder).rstrip("/")
    whole = F.regexp_replace("path", r"^\w+:/+", "/")
    below = F.substring(whole, F.position(F.lit(f"{root}/"), whole) + len(root) + 1, F.length(whole))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.where((F.col("length") <= MAX_FILE_BYTES) & ~below.rlike(f"(?:^|/)(?:{skipped})/"))
    return small.where(~F.contains("content", F.lit(b"\0"))).select("path", F.decode("content", "UTF-8").alias("content"))


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """Unified diffs as rows: (key, path, old_path, status, hunk, ord, kind, line, old_no, new_no).

    One row per context, added or deleted line. Headers are carried forward with windows over the diff's lines, and
    line numbers are running counts within a hunk. Lines before the first hunk of a file, texts that are no diffs and
    null texts give no rows. A window holds one diff at a time.
    """
    rows = exploded_lines(diffs, text, key).withColumnRenamed("line_no", "ord")
    line = F.col("line")
    by = Window.partitionBy(key).orderBy("ord")
    file_no = F.count_if(line.startswith("diff --git ")).over(by)
    rows = rows.withColumn("file_no", file_no).where("file_no > 0")
    in_file = Window.partitionBy(key, "file_no").orderBy("ord")
    whole = Window.partitionBy(key, "file_no")
    header = F.regexp_extract(line, r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", 0) != ""
    rows = rows.withColumn("hunk", F.count_if(header).over(in_file))
    meta = F.col("hunk") == 0
    first = lambda p: F.max(F.when(meta, F.nullif(F.regexp_extract(line, p, 1), F.lit("")))).over(whole)
    has = lambda p: F.max(meta & line.rlike(p)).over(whole)
    named = F.coalesce(first(r"^\+\+\+ b/(.+?)\t?$"), first(r"^rename to (.+)$"), first(r"^--- a/(.+?)\t?$"), first(r"^diff --git a/.+ b/(.+)$"))
    status = (
        F.when(has("^Binary files |^GIT binary patch"), "binary")
        .when(has("160000$"), "submodule")
        .when(has("^new file mode"), "added")
        .when(has("^deleted file mode"), "deleted")
        .when(has("^rename from "), "renamed")
        .when(has("^new mode "), "mode")
        .otherwise("modified")
    )
    rows = rows.select("*", named.alias("path"), first(r"^rename from (.+)$").alias("old_path"), status.alias("status"))
    in_hunk = Window.partitionBy(key, "file_no", "hunk").orderBy("ord")
    start = lambda g: F.first(F.when(header, F.regexp_extract(line, r"^@@ -(\d+)(?:,\d+)? \+(\d+)", g).cast("int")), ignorenulls=True).over(in_hunk)
    kind = F.when(line.startswith("+"), "added").when(line.startswith("-"), "deleted").when(line.startswith(" ") | (line == ""), "context")
    body = rows.where("hunk > 0").select("*", start(1).alias("old_start"), start(2).alias("new_start"), F.when(~header, kind).alias("kind"))
    before = in_hunk.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *kinds: F.coalesce(F.count_if(F.col("kind").isin(*kinds)).over(before), F.lit(0))
    numbered = body.select("*", (F.col("old_start") + count("context", "deleted")).alias("old_at"), (F.col("new_start") + count("context", "added")).alias("new_at"))
    return numbered.where("kind IS NOT NULL").select(
        key, "path", "old_path", "status", F.col("hunk").cast("int").alias("hunk"), "ord", "kind",
        F.substring(line, 2, 1 << 30).alias("line"),
        F.when(F.col("kind") != "added", F.col("old_at")).cast("int").alias("old_no"),
        F.when(F.col("kind") != "deleted", F.col("new_at")).cast("int").alias("new_no"),
    )


def added_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, line_no): the lines a diff adds."""
    return diff_lines(diffs, key, text).where("kind = 'added'").select(key, "path", F.col("new_no").alias("line_no"))

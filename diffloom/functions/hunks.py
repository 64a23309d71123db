"""Text of hunks: numbered lines written as text and read back, places of findings, values of slots."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hunk_text(lines: Column, header: Column | None = None) -> Column:
    """Lines (structs kind, no, text) as text: ``L12 + x`` for added, ``L12   x`` for context and ``D3 - x`` for deleted ones.

    Lines without a number are left out; no lines and no header give the empty text.
    """
    one = lambda s: F.when(s["kind"] == "deleted", F.concat(F.lit("D"), s["no"].cast("string"), F.lit(" - "), s["text"])).otherwise(
        F.concat(F.lit("L"), s["no"].cast("string"), F.when(s["kind"] == "added", " + ").otherwise("   "), s["text"])
    )
    body = F.transform(F.filter(lines, lambda s: s["no"].isNotNull() & s["text"].isNotNull()), one)
    return F.array_join(F.concat(F.array(header), body) if header is not None else body, "\n")


def hunk_lines(text: Column) -> Column:
    """The added and deleted lines (kind, no, text) of a hunk's text, in order; other lines are left out."""
    part = lambda x, g: F.regexp_extract(x, r"(?s)^([LD])(\d+) ([+-]) (.*)$", g)
    rows = F.transform(F.split(text, "\n"), lambda x: F.struct(F.when((part(x, 1) == "L") & (part(x, 3) == "+"), "added").when((part(x, 1) == "D") & (part(x, 3) == "-"), "deleted").alias("kind"), F.nullif(part(x, 2), F.lit("")).cast("int").alias("no"), part(x, 4).alias("text")))
    return F.filter(rows, lambda s: s["kind"].isNotNull())


def location(anchors: Column, added: Column, start: Column, choice: Column, confidence: Column) -> Column:
    """struct(line, by, uncertain): where a finding is shown.

    With anchors, the chosen line if it is one of them, else the first anchor (by trigger). Without, the chosen line if
    it is an added one (by choice), else the first added line or the start (by unit, uncertain). A choice ``L<n>`` counts
    from a confidence of 0.5 on; lines below 1 become 1.
    """
    chosen = F.when((confidence >= 0.5) & choice.rlike(r"^L\d+$"), F.substring(choice, 2, 9).cast("int"))
    some = F.size(F.coalesce(anchors, F.array())) > 0
    by_trigger = F.when(F.array_contains(anchors, chosen), chosen).otherwise(F.get(anchors, 0))
    is_added = F.coalesce(F.array_contains(added, chosen), F.lit(False))
    line = F.when(some, by_trigger).when(is_added, chosen).otherwise(F.coalesce(F.get(added, 0), start))
    by = F.when(some, "trigger").when(is_added, "choice").otherwise("unit")
    return F.struct(F.greatest(line, F.lit(1)).alias("line"), by.alias("by"), (by == "unit").alias("uncertain"))


def slot_value(source: str, line: Column, pattern: str, answer: Column | None = None) -> Column:
    """The value of a slot: ``regex:n`` is a group of the pattern on the line, ``choose`` an answer other than "other".

    What isn't there is the empty text.
    """
    if source.startswith("regex:"):
        return F.coalesce(F.regexp_extract(line, pattern, int(source.removeprefix("regex:"))), F.lit(""))
    return F.when(answer != "other", answer).otherwise(F.lit("")) if answer is not None else F.lit("")

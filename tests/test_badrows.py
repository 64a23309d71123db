import re

import pytest

from diffloom.operators.badrows import bad_records, load_alerts

FEEDS = [("c", ",", 4, ["path", "line", "rule_id", "level"]), ("p", "|", 3, ["line", "path", "rule_id"]), ("t", "\t", 4, ["rule_id", "path", "line", "message"])]
CASES = [
    # feed, record, first reason or None
    ("c", "a.py,1,r,error", None),
    ("c", "a.py,1,r,error\r", None),
    ("c", "a.py,1,r,error\r\r", "broken quoting"),
    ("c", '"a,b.py","1","r","Note"', None),
    ("c", '"a""b.py",1,r,', None),
    ("c", 'a"b.py,1,r,error', "broken quoting"),
    ("c", '"a.py"x,1,r,error', "broken quoting"),
    ("c", '"a.py,1,r,error', "broken quoting"),
    ("c", "a.py,1,r", "too few fields"),
    ("c", "a.py,1,r,error,x", "too many fields"),
    ("c", "", "too few fields"),
    ("c", "a.py, 12 ,r, WARNING ", None),
    ("c", "a.py,0,r,error", "line is out of range"),
    ("c", "a.py,2147483647,r,error", None),
    ("c", "a.py,2147483648,r,error", "line is out of range"),
    ("c", "a.py,00000000000000000012,r,error", None),
    ("c", "a.py,99999999999999999999999,r,error", "line is out of range"),
    ("c", "a.py,-1,r,error", "line is not a whole number"),
    ("c", "a.py,١,r,error", "line is not a whole number"),
    ("c", " ,1,r,error", "path is blank"),
    ("c", "a�.py,1,r,error", "path has control or replacement characters"),
    ("c", "a\u0085.py,1,r,error", "path has control or replacement characters"),
    ("c", "a.py,1,,error", "rule_id is empty"),
    ("c", "a.py,1,r s,error", "rule_id has white space or control characters"),
    ("c", "a.py,1,r,fatal", "level is unknown"),
    ("c", "a.py,1,r,   ", None),
    ("p", "1|a.py|r", None),
    ("p", '1|"a|b.py"|r', None),
    ("p", "1|a.py|r|x", "too many fields"),
    ("t", 'r\ta.py\t3\t"two\nlines"', None),
    ("t", "r\ta.py\t3\tm", None),
    ("x", "r", "unknown feed"),
    ("c", None, "no record"),
]


def tables(spark, cases=CASES):
    lines = spark.createDataFrame([(i, f, r, "extra") for i, (f, r, _) in enumerate(cases)], "raw_id bigint, feed string, raw_line string, reason string")
    return lines, spark.createDataFrame(FEEDS, "feed string, delimiter string, n_columns int, column_names array<string>")


def test_each_case(spark):
    got = {r["raw_id"]: r["reasons"] for r in bad_records(*tables(spark)).collect()}
    want = {i: reason for i, (_, _, reason) in enumerate(CASES) if reason}
    assert set(got) == set(want)
    assert all(want[i] in got[i] for i in want)


def test_valid_records_are_typed(spark):
    rows = {r["raw_id"]: r for r in load_alerts(*tables(spark)).collect()}
    assert set(rows) == {i for i, (_, _, reason) in enumerate(CASES) if not reason}
    assert rows[3]["path"] == "a,b.py" and rows[3]["line"] == 1 and rows[3]["level"] == "note"
    assert rows[4]["path"] == 'a"b.py' and rows[4]["level"] is None
    assert rows[11]["line"] == 12 and rows[11]["level"] == "warning"


def test_repeated_and_empty(spark):
    lines, feeds = tables(spark, [("c", "a.py,x,r,error", "")] * 3)
    assert bad_records(lines.withColumn("raw_id", lines.raw_id * 0), feeds).count() == 1
    assert bad_records(lines.limit(0), feeds).count() == 0
    assert load_alerts(lines.limit(0), feeds).count() == 0


def test_a_value_that_a_third_of_all_records_share(spark):
    lines, feeds = tables(spark, [("c", f"a{i}.py,{'x' if i % 3 == 0 else i + 1},r,error", "") for i in range(600)])
    assert bad_records(lines, feeds).count() == 200


def test_frequent_valid_values_and_kept_columns(spark):
    lines, feeds = tables(spark, [("c", f"a.py,{'7' if i % 3 else 'x' if i % 2 else i + 1},r,warning", "") for i in range(600)])
    got = load_alerts(lines.withColumn("repo", lines.raw_id % 5), feeds, keep=("repo",)).toPandas()
    assert len(got) == 500 and (got[got.raw_id % 3 > 0].line == 7).all() and (got.repo == got.raw_id % 5).all() and not got.line.isna().any()


def brute(record: str, delimiter: str):
    """Fields of a record, or None: a scanner, to compare the patterns with."""
    out, i = [], 0
    while True:
        if record[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(record, i)
            if not m:
                return None
            out.append(m[1].replace('""', '"'))
            i = m.end()
            if i == len(record):
                return out
            if record[i] != delimiter:
                return None
            i += 1
        else:
            j = record.find(delimiter, i)
            field = record[i:] if j < 0 else record[i:j]
            if '"' in field or "\n" in field or "\r" in field:
                return None
            out.append(field)
            if j < 0:
                return out
            i = j + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_structure_against_a_scanner(spark, seed):
    import random

    rnd = random.Random(seed)
    records = ["".join(rnd.choice('a,"\n| b') for _ in range(rnd.randrange(12))) for _ in range(400)]
    lines, feeds = tables(spark, [("c", r, "") for r in records])
    got = {r["raw_id"]: r["reasons"] for r in bad_records(lines, feeds).collect()}
    for i, r in enumerate(records):
        fields = brute(r, ",")
        if fields is None:
            assert got[i] == ["broken quoting"], r
        elif len(fields) != 4:
            assert got[i] == ["too few fields" if len(fields) < 4 else "too many fields"], r

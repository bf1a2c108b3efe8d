import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertloom.sources.artifacts import (as_text, file_extension, read_artifacts, reject_reason, split_intake,
                                         with_reject_reason)
from alertloom.sources.csv_logs import parse_logs, split_csv_line

HEADER = "eventTime,eventName,eventSource,sourceIPAddress,userIdentityuserName,errorCode,userAgent"


def parse(spark, *texts):
    return parse_logs(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "artifact_id string, raw string"))


def test_typed_columns_and_map(spark):
    row = parse(spark, f"\n  \n{HEADER}\r\nt0,Get,s3, 1.2.3.4 ,bob,,cli\r\n\r\n").first()
    assert (row.event_time, row.event_name, row.source_ip, row.user_name, row.error_code, row.user_agent) == (
        "t0", "Get", "1.2.3.4", "bob", "", "cli")
    assert row.fields["eventsource"] == "s3" and row.fields["errorcode"] == ""
    assert row.error_message == ""


def test_short_and_long_rows(spark):
    rows = parse(spark, f"{HEADER}\nt0,x,y\n1,2,3,4,5,6,7,8").orderBy("line_no").collect()
    assert (rows[0].event_name, rows[0].source_ip, set(rows[0].fields)) == ("x", "", {"eventtime", "eventname", "eventsource"})
    assert rows[1].user_agent == "7" and len(rows[1].fields) == 7


def test_quotes(spark):
    row = parse(spark, 'event,user\n"Console, Web","a ""b"" c"').first()
    assert (row.event_name, row.user_name) == ("Console, Web", 'a "b" c')


def test_leftmost_alias_wins_and_duplicate_keys_take_the_last(spark):
    row = parse(spark, "user,userName,a.b,a_b\nfirst,second,x,y").first()
    assert row.user_name == "first"
    assert row.fields == {"user": "first", "username": "second", "ab": "y"}


def test_headers_differ_between_artifacts(spark):
    rows = {r.artifact_id: r for r in parse(spark, "event\nA", "IP,event\n1.1.1.1,B", "", "event\n").collect()}
    assert set(rows) == {"0", "1"}
    assert (rows["0"].event_name, rows["1"].event_name, rows["1"].source_ip) == ("A", "B", "1.1.1.1")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab," x', max_size=6), min_size=1, max_size=4), min_size=1, max_size=8))
def test_split_agrees_with_a_writer(spark, rows):
    """Whatever a CSV writer quotes, the splitter reads back."""
    lines = []
    for fields in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
        lines.append((out.getvalue(), [f.strip() for f in fields]))
    df = spark.createDataFrame(lines, "line string, want array<string>")
    for r in df.select(split_csv_line(F.col("line")).alias("got"), "want").collect():
        assert r.got == r.want


def scan(line):
    """Character by character reading of one line."""
    fields, current, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1:i + 2] == '"':
            current, i = current + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append(current)
            current = ""
        else:
            current += c
        i += 1
    return [f.strip() for f in [*fields, current]]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab,"', min_size=1, max_size=12), min_size=1, max_size=30))
def test_split_of_broken_lines(spark, lines):
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    for r in df.select("line", split_csv_line(F.col("line")).alias("got")).collect():
        assert r.got == scan(r.line), r.line


def test_long_quoted_field(spark):
    line = '"' + "x" * 50_000 + '"",' + '",b'
    df = spark.createDataFrame([(line,)], "line string")
    assert len(df.select(split_csv_line(F.col("line")).alias("f")).first().f) == 2


@pytest.mark.parametrize("name, content, reason", [
    ("a.eml", b"From: x\n\nbody", None), ("a.CSV", b"a,b\n1,2", None), ("a.json", b" \r\n\t[1]", None),
    ("a.json", b"hello", "not_json"), ("a.json", b"  \n", "empty_file"), ("a.csv", b"", "empty_file"),
    ("a.txt", b"x", "unsupported_type"), ("a", b"x", "unsupported_type"), ("a.csv", b"MZ..", "executable_or_archive"),
    ("a.csv", b"\x7fELF", "executable_or_archive"), ("a.eml", b"%PDF-1", "executable_or_archive"),
    ("a.csv", b"PK\x03\x04", "executable_or_archive"), ("a.csv", b"\xcf\xfa\xed\xfe", "executable_or_archive"),
    ("a.csv", b"a,b\x00", "binary_data"), ("a.csv", b"a" * 5000 + b"\x00", None),
    ("a.eml", b"no header\nFrom: x", "no_email_headers"), ("a.csv", b"x" * (10 * 1024 * 1024 + 1), "too_large"),
])
def test_reject_reasons(spark, name, content, reason):
    df = spark.createDataFrame([(name, bytearray(content))], "path string, content binary")
    out = df.select(reject_reason(file_extension("path"), F.octet_length("content"), F.col("content")).alias("r"))
    assert out.first().r == reason


def test_artifact_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.eml").write_bytes(b"\xef\xbb\xbfFrom: a@b.c\nSubject: s\n\nx")
    (tmp_path / "b.csv").write_text("event\nA")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    artifacts = read_artifacts(spark, str(tmp_path))
    ok, bad = split_intake(artifacts)
    assert sorted((r.file_name, r.file_type) for r in ok.collect()) == [("a.eml", "Eml"), ("b.csv", "Csv")]
    assert [(r.file_name, r.reject_reason) for r in bad.collect()] == [("c.exe", "unsupported_type")]
    assert as_text(ok.filter("file_type = 'Eml'")).first().raw.startswith("From:")
    assert with_reject_reason(artifacts).count() == 3

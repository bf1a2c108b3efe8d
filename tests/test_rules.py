import pytest
from pyspark.sql import functions as F

from alertloom.operators import rules as R
from alertloom.sources.rule_pack import RuleError, load_rules, parse_rule, slugify


def rule(detection, title="t"):
    return parse_rule(f"title: {title}\ndetection:\n" + "\n".join("  " + l for l in detection.strip().splitlines()))


def fires(spark, detection, **fields):
    df = spark.createDataFrame([(fields,)], "fields map<string,string>")
    return df.select(R.rule_column(rule(detection)).alias("m")).first().m


@pytest.mark.parametrize("detection, fields, want", [
    ("s: {a: X}\ncondition: s", {"a": "x"}, True),
    ("s: {a: X}\ncondition: s", {"a": "xy"}, False),
    ("s: {A.b_c: x}\ncondition: s", {"abc": "x"}, True),
    ("s: {a|contains: b}\ncondition: s", {"a": "aBc"}, True),
    ("s: {a|startswith: b}\ncondition: s", {"a": "abc"}, False),
    ("s: {a|endswith: C}\ncondition: s", {"a": "abc"}, True),
    ("s: {a|contains: 'b*'}\ncondition: s", {"a": "abc"}, False),
    ("s: {a|contains: 'A?c'}\ncondition: s", {"a": "abc"}, True),
    ("s: {a: 'a*c'}\ncondition: s", {"a": "a.b\nc"}, True),
    ("s: {a: 'a.c'}\ncondition: s", {"a": "abc"}, False),
    ("s: {a: '*'}\ncondition: s", {"a": ""}, False),
    ("s: {a: '*'}\ncondition: s", {}, False),
    ("s: {a: ''}\ncondition: s", {"a": ""}, False),
    ("s: {a: x}\nn: {b: y}\ncondition: s and not n", {"a": "x"}, True),
    ("s: {a: [x, y], b: z}\ncondition: s", {"a": "y", "b": "z"}, True),
    ("s: {a: [x, y], b: z}\ncondition: s", {"a": "y"}, False),
    ("x1: {a: '1'}\nx2: {b: '1'}\ncondition: 1 of x*", {"b": "1"}, True),
    ("x1: {a: '1'}\nx2: {b: '1'}\ncondition: all of x*", {"b": "1"}, False),
    ("x1: {a: '1'}\nx2: {b: '1'}\ncondition: all of them", {"a": "1", "b": "1"}, True),
    ("x1: {a: '1'}\ncondition: all of none*", {"a": "1"}, False),
    ("x1: {a: '1'}\ncondition: not 1 of none*", {}, True),
    ("a: {a: '1'}\nb: {b: '1'}\nc: {c: '1'}\ncondition: a or b and c", {"a": "1"}, True),
    ("a: {a: '1'}\nb: {b: '1'}\nc: {c: '1'}\ncondition: (a or b) and c", {"a": "1"}, False),
    ("a: {a: '1'}\nb: {b: '1'}\ncondition: not a and b", {"b": "1"}, True),
    ("a: {a: yes}\ncondition: a", {"a": "Yes"}, True),
    ("a: {a: 1}\ntimeframe: 5m\ncondition: a", {"a": "1"}, True),
])
def test_conditions(spark, detection, fields, want):
    assert fires(spark, detection, **fields) is want


@pytest.mark.parametrize("text", [
    "detection: {a: {b: c}, condition: a}", "title: t", "title: t\ndetection: {a: {b: c}}", "title: t\ndetection: {condition: a}",
    "title: t\ndetection: {a: [x], condition: a}", "title: t\ndetection: {a: {b|re: c}, condition: a}",
    "title: t\ndetection: {a: {b: c}, condition: z}", "title: t\ndetection: {a: {b: c}, condition: a and}",
    "title: t\ndetection: {a: {b: c}, condition: (a}", "title: t\ndetection: {a: {b: c}, condition: a a}",
    "title: t\ndetection: {a: {b: {c: d}}, condition: a}", "- x", "title: t\ndetection: {a: {b: c}, condition: and}",
])
def test_broken_rules_are_refused(text):
    with pytest.raises(RuleError):
        parse_rule(text)


def test_defaults_and_slug():
    r = rule("s: {a: b}\ncondition: s", title="'  AWS: Root -- Usage! '")
    assert (r.level, r.slug) == ("informational", "aws_root_usage")
    assert slugify("__a__b__") == "a_b"


def test_slug_column_agrees(spark):
    titles = ["AWS: Root -- Usage!", "__a__b__", "Größe 12%", "", "!!"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.s for r in df.select(R.slug_column(F.col("t")).alias("s")).collect()] == [slugify(t) for t in titles]


def test_folder_keeps_good_rules(tmp_path, spark):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.yml").write_text("title: b\ndetection: {s: {x: '1'}, condition: s}")
    (tmp_path / "sub" / "A.yaml").write_text("title: a\ndetection: {s: {x: '1'}, condition: s}")
    (tmp_path / "bad.yml").write_text("title: [")
    (tmp_path / "note.txt").write_text("x")
    pack = load_rules(str(tmp_path))
    assert [r.title for r in pack.rules] == ["b", "a"]
    assert [e[0] for e in pack.load_errors] == ["bad.yml"]
    assert R.load_errors(spark, pack).count() == 1


def test_shipped_pack(spark):
    pack = load_rules()
    assert len(pack.rules) == 9 and not pack.load_errors
    rows = [
        ("login", {"eventsource": "signin.amazonaws.com", "eventname": "ConsoleLogin"}, ["aws_console_login_without_mfa"]),
        ("mfa", {"eventsource": "signin.amazonaws.com", "eventname": "ConsoleLogin", "additionaleventdatamfaused": "yes"}, []),
        ("root", {"useridentitytype": "root", "errorcode": ""}, ["aws_root_account_usage"]),
        ("root error", {"useridentitytype": "Root", "errorcode": "x"}, []),
        ("open", {"eventname": "authorizesecuritygroupingress", "requestparametersipv6cidrblock": "::/0"},
         ["aws_security_group_opened_to_the_world"]),
    ]
    df = spark.createDataFrame(rows, "artifact_id string, fields map<string,string>, want array<string>")
    for r in df.select("artifact_id", R.matched_rules(pack).alias("got"), "want").collect():
        assert r.got == r.want, r.artifact_id


def test_hits_are_counted_and_ordered(spark):
    pack = load_rules()
    login = {"eventsource": "signin.amazonaws.com", "eventname": "ConsoleLogin"}
    root = {"useridentitytype": "Root"}
    df = spark.createDataFrame([("a", root), ("a", login), ("a", login), ("b", root)], "artifact_id string, fields map<string,string>")
    hits = R.order_hits(R.rule_hits(df, pack)).collect()
    assert [(h.artifact_id, h.slug, h.hits) for h in hits][0] == ("a", "aws_console_login_without_mfa", 2)
    assert {(h.artifact_id, h.hits) for h in hits[1:]} == {("a", 1), ("b", 1)}


def test_rules_over_columns_are_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("ListUsers", 1)], "eventName string, x int").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    hit = df.filter(R.rule_column(rule("s: {eventName: listusers}\ncondition: s"), R.column_fields(df)))
    assert hit.count() == 1
    missing = df.filter(R.rule_column(rule("s: {other: x}\ncondition: not s"), R.column_fields(df)))
    assert missing.count() == 1


def test_large_packs_are_chunked(spark):
    pack = load_rules()
    many = type(pack)(tuple(
        rule(f"s: {{a: '{i}'}}\ncondition: s", title=f"r{i}") for i in range(230)
    ))
    df = spark.createDataFrame([({"a": "229"},), ({"a": "5"},), ({"a": "x"},)], "fields map<string,string>")
    assert [r.m for r in df.select(R.matched_rules(many).alias("m")).collect()] == [["r229"], ["r5"], []]
    assert df.select(F.size(R.matched_rules(type(pack)(()))).alias("n")).first().n == 0

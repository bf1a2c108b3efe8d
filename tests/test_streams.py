import datetime as dt

from pyspark.sql import functions as F

from alertloom.schemas import REPORT
from alertloom.sources import sinks
from alertloom.sources.rule_pack import load_rules
from alertloom.streaming import triage_stream as S
from alertloom.streaming import windows

T0 = dt.datetime(2026, 3, 1, 12)
BAD = "From: x <x@secure-banking-login.com>\nSubject: Urgent: verify your account\nReceived: from a ([185.220.101.5])\n\nsee http://evil.xyz/a"
GOOD = "From: a@example.org\nSubject: lunch\n\nnoon?"
LOG = "eventTime,eventName,sourceIPAddress,userIdentityuserName\n" + "\n".join(f"t,{e},10.0.0.1,eve" for e in ("ListUsers", "ListRoles", "ListBuckets", "AssumeRole"))


def run(spark, inbox, root, checkpoint):
    activity = spark.createDataFrame([(T0, "GetObject", "10.0.0.1", "eve", "eu", "{}")],
                                     "event_time timestamp, event_name string, source_ip string, user_identity string, aws_region string, raw_event string")
    q = S.start_triage(spark, str(inbox), str(root), str(checkpoint), load_rules(), available_now=True, activity=activity)
    q.awaitTermination()


def table(spark, root, name):
    return spark.read.parquet(f"{root}/{name}")


def test_triage_stream_end_to_end(spark, tmp_path):
    inbox, root, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    inbox.mkdir()
    for name, text in [("bad.eml", BAD), ("good.eml", GOOD), ("log.csv", LOG), ("x.json", '{"a":1}'), ("v.exe", "MZ")]:
        (inbox / name).write_text(text)
    run(spark, inbox, root, checkpoint)
    jobs = {r.file_name: r for r in table(spark, root, "jobs").collect()}
    assert {k: (v.status, v.current_step) for k, v in jobs.items()} == {
        "bad.eml": ("Done", "done"), "good.eml": ("Done", "tier1.done"), "log.csv": ("Done", "done"), "x.json": ("Done", "done")}
    assert [r.reject_reason for r in table(spark, root, "quarantine").collect()] == ["unsupported_type"]
    reports = {r.job_id: r for r in table(spark, root, "reports").collect()}
    assert set(reports) == {jobs[n].id for n in ("bad.eml", "log.csv", "x.json")}
    assert reports[jobs["bad.eml"].id].mitre == ["T1566.002", "T1566"]
    assert reports[jobs["log.csv"].id].mitre == ["T1087", "T1098"]
    assert any(e.source == "cloudtrail" for e in reports[jobs["log.csv"].id].evidence)
    intel = table(spark, root, "threat_intel")
    assert intel.filter("value = '185.220.101.5' AND source = 'VirusTotal'").first().malicious_score == 0.55

    # A second run adds only what is new, and reuses the cached intel of the shared address.
    (inbox / "again.eml").write_text(BAD.replace("lunch", "x"))
    run(spark, inbox, root, checkpoint)
    assert table(spark, root, "reports").count() == 4
    assert table(spark, root, "threat_intel").filter("value = '185.220.101.5'").count() == 2

    # A replayed batch replaces itself.
    batch = S.describe(spark.read.format("binaryFile").load(str(inbox / "again.eml")))
    S.process_batch(batch, 1, str(root), load_rules())
    assert table(spark, root, "reports").count() == 4
    # An artifact that another batch has finished is skipped.
    S.process_batch(batch, 7, str(root), load_rules())
    assert table(spark, root, "tier1_results").groupBy("job_id").count().filter("count > 1").count() == 0
    assert sinks.read_table(spark, str(root), "reports", REPORT).count() == 4


def accesses(spark):
    rows = [(i, T0 + dt.timedelta(seconds=s), ip) for i, (s, ip) in enumerate([*[(s, "a") for s in range(12)], *[(s, "b") for s in range(10)], (70, "a"), (3600, "z")])]
    return spark.createDataFrame(rows, "event_id int, ts timestamp, source_ip string")


def test_a_mail_in_another_encoding_stops_nothing(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "latin.eml").write_bytes(BAD.replace("see", "caf\u00e9").encode("latin-1"))
    (inbox / "name.eml").write_text(BAD + " " + "a." * 4000 + "com")
    batch = S.describe(spark.read.format("binaryFile").load(str(inbox)))
    S.process_batch(batch, 0, str(root), load_rules())
    jobs = {r.file_name: r.status for r in table(spark, root, "jobs").collect()}
    assert jobs == {"latin.eml": "Done", "name.eml": "Done"}
    assert table(spark, root, "reports").count() == 2


def test_limits_on_a_table(spark):
    got = windows.limit_breaches(accesses(spark), 10).collect()
    assert [(r.window_start, r.source_ip, r.n, r.rejected) for r in got] == [(T0, "a", 12, 2)]
    assert [r.event_id for r in windows.rejected_requests(accesses(spark), 10).orderBy("event_id").collect()] == [10, 11]


def test_limits_on_a_stream(spark, tmp_path):
    accesses(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(accesses(spark).schema).parquet(str(tmp_path / "in"))
    q = windows.limit_breaches(stream, 10).writeStream.format("memory").queryName("breaches").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.source_ip, r.n) for r in spark.table("breaches").collect()] == [("a", 12)]


def test_rolling_counts(spark):
    jobs = spark.createDataFrame([(T0,), (T0 + dt.timedelta(minutes=59),), (T0 + dt.timedelta(hours=23),)], "created_at timestamp")
    got = {r.window_end: r.n for r in windows.rolling_counts(jobs).collect()}
    assert got[T0 + dt.timedelta(hours=1)] == 2 and got[T0 + dt.timedelta(hours=24)] == 3 and got[T0 + dt.timedelta(hours=25)] == 1
    assert sum(got.values()) == 3 * 24


def test_activity_table_is_pruned(spark, tmp_path):
    from alertloom.sources.activity import newest_for, read_activity, write_activity
    rows = [(T0 + dt.timedelta(days=d), f"e{d}", f"ip{d % 2}", "u") for d in range(6)]
    write_activity(spark.createDataFrame(rows, "event_time timestamp, event_name string, source_ip string, user_identity string"), str(tmp_path / "act"))
    days = read_activity(spark, str(tmp_path / "act"), "2026-03-02", "2026-03-04")
    assert days.count() == 3 and len(days.inputFiles()) == 6  # files are listed, partitions are pruned at planning
    assert "PartitionFilters: [isnotnull(event_date" in days._jdf.queryExecution().toString()
    assert [r.event_name for r in newest_for(read_activity(spark, str(tmp_path / "act")), ["ip0"], 2).collect()] == ["e4", "e2"]


def test_sink_replay(spark, tmp_path):
    df = spark.range(3).select(F.col("id").cast("string").alias("job_id"))
    for batch in (0, 1, 1):
        sinks.write_batch(df, str(tmp_path), "iocs", batch)
    assert sinks.read_table(spark, str(tmp_path), "iocs", "job_id string").count() == 6
    assert sinks.read_other_batches(spark, str(tmp_path), "iocs", "job_id string", 1).count() == 3
    assert sinks.read_table(spark, str(tmp_path), "none", "job_id string").count() == 0


def test_jobs_wait_for_answers_over_batches(spark, tmp_path):
    from alertloom.streaming import job_states as J

    m = lambda *rows: spark.createDataFrame([(j, k, f, u, None, T0 + dt.timedelta(minutes=t)) for j, k, f, u, t in rows], J.MESSAGE)
    batches = [
        m(("a", "job", "Eml", None, 0), ("b", "job", "Csv", None, 0), ("c", "synthesis", None, True, 1), ("d", "job", "Csv", None, 0), (None, "job", "Csv", None, 0)),
        m(("a", "email_analysis", None, False, 5), ("b", "synthesis", None, True, 6), ("c", "job", "Csv", None, 7), ("a", "job", "Eml", None, 8)),
        m(("a", "email_analysis", None, True, 20), ("b", "synthesis", None, False, 20), ("d", "synthesis", None, True, 61)),
        m(("z", "job", "Csv", None, 300)),
    ]
    for n, b in enumerate(batches):
        b.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(J.MESSAGE).parquet(str(tmp_path / "in/*"))
        q = J.run_jobs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    moves = spark.read.schema(J.MOVE).parquet(str(tmp_path / "out"))
    now = {r.job_id: (r.step, r.prompts, r.error_message) for r in J.current_states(moves).collect()}
    assert now == {
        "a": ("tier2.failed", 3, "No answer for synthesis in time."), "b": ("done", 1, None), "c": ("done", 1, None),
        "d": ("tier2.failed", 1, "No answer for synthesis in time."), "z": ("tier2.synthesis_pending", 1, None)}
    assert [r.attempt for r in moves.where("job_id = 'a'").orderBy("ord").collect()] == [1, 2, 1, None]


def test_answers_are_judged_outside_of_the_state(spark):
    from alertloom.streaming import job_states as J

    good = '{"risk_score":6.0,"severity":"High","summary_markdown":"s","mitre_techniques":["T1566"],"evidence_trail":[{"claim":"c","source":"s"}]}'
    rows = spark.createDataFrame([("a", good, T0), ("b", good.replace("High", "Low"), T0), ("c", None, T0)], "job_id string, response string, at timestamp")
    got = {r.job_id: (r.usable, len(r.violations)) for r in J.answer_messages(rows, "synthesis").collect()}
    assert got["a"] == (True, 0) and not got["b"][0] and got["b"][1] == 1 and got["c"] == (False, 1)


def test_a_batch_with_a_classifier_answers_and_earlier_incidents(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    names = ["one.eml", "two.eml", "three.eml"]
    for n in names:
        (inbox / n).write_text(BAD.replace("see", n))
    read = lambda pattern: S.describe(spark.read.format("binaryFile").load(str(inbox / pattern)))
    S.process_batch(read("one.eml"), 0, root, load_rules())
    first = table(spark, root, "jobs").first()
    assert first.current_step == "done"
    embedded = table(spark, root, "incident_embeddings").collect()
    assert [(r.job_id, r.version, len(r.embedding)) for r in embedded] == [(first.id, "1", 384)]

    # The second batch: a quiet mail that only the classifier suspects, one job unanswered, one answered badly twice.
    (inbox / "quiet.eml").write_text(GOOD)
    ids = {r.file_name: r.artifact_id for r in S.describe(spark.read.format("binaryFile").load(str(inbox))).select("file_name", "artifact_id").collect()}
    answer = lambda name, n, text: (ids[name], n, text)
    good = '{"risk_score":6.0,"severity":"High","summary_markdown":"told","mitre_techniques":["T1566"],"evidence_trail":[{"claim":"c","source":"s"}]}'
    kind = "job_id string, attempt int, response string"
    S.process_batch(
        read("{two,three,quiet}.eml"), 1, root, load_rules(),
        classifier=lambda texts: texts.select("artifact_id", F.when(F.col("text").contains("lunch"), 0.9).otherwise(0.1).alias("ml_score")),
        email_answers=spark.createDataFrame([answer("three.eml", 1, "no"), answer("three.eml", 2, "{")], kind),
        synthesis_answers=spark.createDataFrame([answer("two.eml", 1, "x"), answer("two.eml", 2, good), answer("three.eml", 1, good)], kind))
    jobs = {r.file_name: (r.status, r.current_step, r.error_message) for r in table(spark, root, "jobs").collect()}
    assert jobs["two.eml"] == ("Done", "done", None)
    assert jobs["three.eml"] == ("Failed", "tier2.failed", "No usable email analysis.")
    assert jobs["quiet.eml"] == ("Analyzing", "tier2.synthesis_pending", None)
    prompts = {(r.job_id, r.kind): r.prompt for r in table(spark, root, "prompts").where("batch_id = 1").collect()}
    assert set(prompts) == {(ids[n], "email_analysis") for n in ("two.eml", "three.eml", "quiet.eml")} | {(ids[n], "synthesis") for n in ("two.eml", "quiet.eml")}
    told = prompts[(ids["two.eml"], "synthesis")]
    assert "Similar past incidents" in told and "similarity 0." in told
    assert "lunch" in prompts[(ids["quiet.eml"], "email_analysis")]
    reports = {r.job_id: r.summary for r in table(spark, root, "reports").collect()}
    assert reports[ids["two.eml"]] == "told" and len(reports) == 2
    assert table(spark, root, "incident_embeddings").count() == 2


def test_the_cache_of_a_stream_answers_as_the_table_does(spark, tmp_path):
    import random

    from alertloom.operators import intel
    from alertloom.streaming import intel_cache as C

    rng = random.Random(21)
    at = lambda h: T0 + dt.timedelta(hours=h)
    # A third of everything is about one address; some answers are exactly as old as the limit.
    known = [("Ip", rng.choice(["hot", "hot", "b", "c"]), "VirusTotal", round(rng.random(), 3), rng.random() < 0.5, at(rng.randrange(0, 96))) for _ in range(120)]
    known += [("Ip", "edge", "VirusTotal", 0.5, True, at(0)), ("Ip", None, "VirusTotal", 0.9, True, at(1))]
    asked = [(i, "Ip", rng.choice(["hot", "b", "none"]), "VirusTotal", at(rng.randrange(0, 120) + 0.5)) for i in range(80)]
    asked += [(900, "Ip", "edge", "VirusTotal", at(24)), (901, "Ip", "edge", "VirusTotal", at(23.99)), (902, "Ip", "edge", "VirusTotal", at(0))]
    cache = spark.createDataFrame(known, "type string, value string, source string, malicious_score double, from_live_api boolean, looked_up_at timestamp")
    asks = spark.createDataFrame(asked, "lookup_id long, type string, value string, source string, at timestamp")
    messages = C.answers(cache).unionByName(C.lookups(asks)).orderBy("at", F.col("lookup_id").isNotNull())
    # In time order over several batches.
    for n, (low, high) in enumerate([(-1, 30), (30, 31), (31, 80), (80, 999)]):
        messages.where((F.col("at") > F.lit(at(low))) & (F.col("at") <= F.lit(at(high)))).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(C.MESSAGE).parquet(str(tmp_path / "in/*"))
        C.run_cache(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.lookup_id: (r.malicious_score, r.from_live_api, r.looked_up_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table_form = intel.cached_as_of(asks, cache.where("value is not null")).where("looked_up_at is not null").collect()
    assert got == {r.lookup_id: (r.malicious_score, r.from_live_api, r.looked_up_at) for r in table_form}
    assert 900 not in got and {901, 902} <= set(got) and len(got) > 50


def test_a_table_is_streamed_from_a_file_and_from_a_folder(spark, data_dir, tmp_path):
    from alertloom.plans.catalog_streams import run_to_table, stream_of
    from alertloom.plans.lens import Lens

    whole = spark.read.parquet(f"{data_dir}/labels.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    whole.write.parquet(f"{tmp_path}/labels.parquet.old")
    for folder in (data_dir, str(tmp_path)):
        assert run_to_table(stream_of(Lens(spark, folder), "labels"), "labels").count() == whole.count()


class FakeHandle:
    """A state store that counts what it is asked for."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(self.timers)


def test_many_jobs_of_a_shard_are_a_few_calls_to_the_store():
    import pandas as pd

    from alertloom.streaming import job_states as J

    handle, machine = FakeHandle(), J.JobMachine(dt.timedelta(hours=1), dt.timedelta(days=7))
    machine.init(handle)
    at = [pd.Timestamp("2026-03-01") + pd.Timedelta(seconds=i) for i in range(500)]
    jobs = pd.DataFrame({"job_id": [str(i) for i in range(500)], "kind": "job", "file_type": "Csv", "usable": None, "violations": None, "at": at})
    moves = pd.concat(list(machine.handleInputRows((1,), iter([jobs]), None)))
    assert len(moves) == 500 and handle.calls <= 4 and len(handle.timers) == 1
    first = min(handle.timers)

    class At:
        getExpiryTimeInMs = getCurrentWatermarkInMs = staticmethod(lambda: first + 2000)

    handle.timers.clear()  # as the engine does with a timer that fires
    late = pd.concat(list(machine.handleExpiredTimer((1,), At, At)))
    assert sorted(late["job_id"]) == ["0", "1", "2"] and set(late["step"]) == {"tier2.failed"}
    assert handle.timers == {first + 3000}


def test_a_busy_address_is_looked_up_without_going_through_all_answers():
    import time

    import pandas as pd

    from alertloom.streaming import intel_cache as C

    n, begin = 40_000, pd.Timestamp("2026-03-01")
    at = [begin + pd.Timedelta(milliseconds=i) for i in range(n)]
    rows = pd.DataFrame({"at": at, "malicious_score": [float(i) if i % 2 == 0 else None for i in range(n)],
                         "from_live_api": [True if i % 2 == 0 else None for i in range(n)],
                         "lookup_id": [None if i % 2 == 0 else i for i in range(n)]})
    handle, cache = FakeHandle(), C.Cache(int(C.TTL.total_seconds() * 1e6))
    cache.init(handle)
    period = int(begin.timestamp() // C.TTL.total_seconds())
    start = time.process_time()
    out = next(cache.handleInputRows(("Ip", "1.1.1.1", "VirusTotal", period), iter([rows]), None))
    assert time.process_time() - start < 5
    assert len(out) == n // 2 and list(out["malicious_score"]) == [float(i - 1) for i in out["lookup_id"]]

"""Registered queries on the continuous side: streams over the given tables, and the batch forms of routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, spread
from ..sources import sinks
from ..streaming import intel_cache as C
from ..streaming import job_states as J
from ..streaming import windows
from . import stages, triage
from .catalog_email import _REPORT
from .catalog_intel import _LOOK
from .lens import JOB_CTE, LOG_CTE, MAIL_EXPRS, REPORT_CTE, Lens, epoch_seconds, query


def stream_of(t: Lens, table: str) -> DataFrame:
    """One of the given tables as a file stream, be it a file or a folder of files."""
    schema = t.table(table).schema
    # A pattern, since only that lets a stream read a single file; a filter on names would find no files in a folder.
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the table it wrote."""
    path = scratch_path(df.sparkSession, name)
    if mode == "update":  # the file sink only appends: every batch writes what it has to tell
        q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: sinks.write_batch(batch, path, "told", batch_id)).option(
            "checkpointLocation", scratch_path(df.sparkSession, f"{name}-checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sinks.read_table(df.sparkSession, path, "told", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", scratch_path(df.sparkSession, f"{name}-checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _StreamLens(Lens):
    """The views over streams instead of tables."""

    def table(self, name: str) -> DataFrame:
        return stream_of(Lens(self.spark, self.folder), name)

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")


@query("t1_continuous_triage", f"""{_REPORT} SELECT artifact_id AS job_id, risk_score, CAST(len(rules) AS INT) AS n_rules,
  CASE WHEN len(rules) > 0 THEN 'Suspicious' ELSE 'Benign' END AS verdict FROM s""")
def _(t):
    """Mails arrive as a stream; every micro-batch runs tier 1 and owns one partition of the results."""
    root = scratch_path(t.spark, "triage")

    def tier1(batch: DataFrame, batch_id: int) -> None:
        known = sinks.read_other_batches(batch.sparkSession, root, "tier1_results", triage.TIER1, batch_id)
        batch = materialize(spread(batch), "triage-batch")
        fresh = stages.not_yet_filtered(batch.withColumnRenamed("artifact_id", "id"), known)
        sinks.write_batch(triage.tier1(fresh.withColumnRenamed("id", "artifact_id"), file_types=["Eml"]), root, "tier1_results", batch_id)

    arriving = _StreamLens(t.spark, t.folder).raw_mails.withColumn("file_type", F.lit("Eml"))
    q = (
        arriving.writeStream.foreachBatch(tier1).option("checkpointLocation", scratch_path(t.spark, "triage-checkpoint"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    done = sinks.read_table(t.spark, root, "tier1_results", triage.TIER1)
    return done.select("job_id", "risk_score", F.size("matched_rules").alias("n_rules"), "verdict")


@query("t1_both_tiers", f"""{_REPORT}, both_tiers AS (SELECT artifact_id AS job_id, len(rules) > 0 AS bad FROM s JOIN (SELECT {MAIL_EXPRS['from_header']} AS from_header, doc_id FROM documents) ON artifact_id = CAST(doc_id AS STRING) WHERE from_header IS NOT NULL)
  SELECT job_id, 'Done' AS status, CASE WHEN bad THEN 'done' ELSE 'tier1.done' END AS current_step, CAST(bad AS INT) AS reported, CAST(bad AS INT) AS stored, CAST(bad AS INT) AS prompts FROM both_tiers""")
def _(t):
    """The whole of ``process_batch``: mails arrive as files do, suspicious ones get intel, a report, a prompt and a vector."""
    from ..streaming.triage_stream import JOBS, process_batch
    root = scratch_path(t.spark, "both-tiers")
    arriving = _StreamLens(t.spark, t.folder).raw_mails.select(
        "artifact_id", F.concat("artifact_id", F.lit(".eml")).alias("file_name"), F.lit(".eml").alias("extension"), F.lit("Eml").alias("file_type"),
        F.concat(F.lit("documents/"), "artifact_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.octet_length("raw").cast("long").alias("length"), F.encode("raw", "UTF-8").alias("content"))
    q = (
        arriving.writeStream.foreachBatch(lambda batch, batch_id: process_batch(spread(batch), batch_id, root, None))
        .option("checkpointLocation", scratch_path(t.spark, "both-tiers-checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = sinks.read_table(t.spark, root, "jobs", JOBS).select(F.col("id").alias("job_id"), "status", "current_step")
    for name, table, rows in (("reported", "reports", "true"), ("stored", "incident_embeddings", "true"), ("prompts", "prompts", "kind = 'synthesis'")):
        found = sinks.read_table(t.spark, root, table, "job_id string, kind string").where(rows).groupBy("job_id").agg(F.count("*").cast("int").alias(name))
        out = out.join(found, "job_id", "left").fillna(0, [name])
    return out


@query("t2_redelivery", f"""WITH {JOB_CTE}, {REPORT_CTE} SELECT id, CASE WHEN current_step = 'tier2.synthesis_pending' THEN 'tier2.synthesis'
  WHEN file_type = 'Eml' THEN 'tier2.email_analysis' ELSE 'tier2.threat_intel' END AS enter_at FROM jobs
  WHERE status = 'Analyzing' AND id NOT IN (SELECT job_id FROM reports)""")
def _(t):
    return stages.ready_for_tier2(t.jobs, t.reports).select("id", "enter_at")


@query("t2_skip_filtered", f"WITH {JOB_CTE}, {REPORT_CTE} SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM reports)")
def _(t):
    return stages.not_yet_filtered(t.jobs, t.reports).select("id")


_UUID = "concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS STRING), 12, '0'))"
_MESSAGE = f"""CASE event_id % 7 WHEN 0 THEN 'garbage' WHEN 1 THEN concat('{{"job":"', {_UUID}, '"}}') WHEN 2 THEN '{{"jobId":"17"}}'
  ELSE concat('{{"jobId":"', {_UUID}, '"}}') END"""


@query("t3_poison_messages", f"SELECT event_id, CASE WHEN event_id % 7 > 2 THEN {_UUID} END AS job_id FROM events")
def _(t):
    messages = t.table("events").selectExpr("event_id", f"{_MESSAGE} AS value")
    good, dead = stages.split_messages(messages)
    return good.select("event_id", "job_id").unionByName(dead.select("event_id", F.lit(None).cast("string").alias("job_id")))


@query("t3_message_stream", f"SELECT {_UUID} AS job_id FROM events WHERE event_id % 7 > 2")
def _(t):
    """Every message is delivered twice; the stream keeps one."""
    from ..streaming.triage_stream import unique_messages
    messages = stream_of(t, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", f"{_MESSAGE} AS value")
    twice = messages.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_to_table(unique_messages(twice).select("job_id"), "messages")


@query("t4_failure_capture", f"""WITH {JOB_CTE}, {REPORT_CTE}, r AS (SELECT job_id, CASE WHEN risk_score >= 5 THEN 'Suspicious' ELSE 'Benign' END AS verdict FROM reports)
  SELECT id, CASE verdict WHEN 'Suspicious' THEN 'Analyzing' WHEN 'Benign' THEN 'Done' ELSE 'Failed' END AS status,
  CASE verdict WHEN 'Suspicious' THEN 'tier2.pending' WHEN 'Benign' THEN 'tier1.done' ELSE 'tier1.failed' END AS current_step,
  CASE WHEN verdict IS NULL THEN coalesce(error_message, 'No Tier 1 result.') END AS error_message FROM jobs LEFT JOIN r ON id = job_id""")
def _(t):
    results = t.reports.select("job_id", F.when(F.col("risk_score") >= 5, "Suspicious").otherwise("Benign").alias("verdict"))
    now = F.lit("2001-01-01").cast("timestamp")
    return stages.after_tier1(t.jobs, results, now).select("id", "status", "current_step", "error_message")


@query("t4_broken_artifacts", f"""{_REPORT}, broken AS (SELECT artifact_id AS id, len(rules) > 0 AS bad, CAST(artifact_id AS BIGINT) % 6 AS k FROM s
    JOIN (SELECT {MAIL_EXPRS['from_header']} AS from_header, doc_id FROM documents) ON artifact_id = CAST(doc_id AS STRING) WHERE from_header IS NOT NULL)
  SELECT id, CASE WHEN k IN (1, 2, 3) THEN 'Failed' ELSE 'Done' END AS status,
  CASE WHEN k IN (1, 2, 3) THEN 'tier1.failed' WHEN bad THEN 'done' ELSE 'tier1.done' END AS current_step,
  CASE k WHEN 1 THEN 'The content could not be read.' WHEN 2 THEN 'The content has no readable text.' WHEN 3 THEN 'The content broke off after 40 of 1000 bytes.' END AS error_message
  FROM broken WHERE k <> 4""")
def _(t):
    """Unreadable, unintelligible, cut and refused files among good ones in one ``process_batch``: each is a row with its message."""
    from ..streaming.triage_stream import JOBS, process_batch
    root = scratch_path(t.spark, "broken")
    k = F.col("artifact_id").cast("bigint") % 6
    whole = F.encode("raw", "UTF-8")
    content = (
        F.when(k == 1, F.lit(None).cast("binary")).when(k == 2, F.lit(b": \xff\xfe\xff \n")).when(k == 3, F.substring(whole, 1, 40))
        .when(k == 4, F.lit(b"MZ\x00")).otherwise(whole))
    mails = t.raw_mails.join(t.mails.where("from_header is not null").select(F.col("doc_id").cast("string").alias("artifact_id")), "artifact_id", "left_semi")
    files = mails.select(
        "artifact_id", F.concat("artifact_id", F.lit(".eml")).alias("file_name"), F.lit(".eml").alias("extension"), F.lit("Eml").alias("file_type"),
        F.concat(F.lit("documents/"), "artifact_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.when(k == 3, 1000).when(k == 1, 17).otherwise(F.octet_length(content)).cast("long").alias("length"), content.alias("content"))
    process_batch(files, 0, root, None)
    return sinks.read_table(t.spark, root, "jobs", JOBS).select("id", "status", "current_step", "error_message")


_STEPS = "['tier2.email_analysis', 'tier2.threat_intel', 'tier2.synthesis_pending', 'tier2.synthesis', 'done']"


@query("t5_stage_routing", f"""WITH {JOB_CTE} SELECT id, CAST(CASE WHEN file_type = 'Eml' THEN 4 ELSE 3 END AS INT) AS n_steps,
  {_STEPS}[list_position({_STEPS}[1:4], current_step) + 1] AS next_step FROM jobs""")
def _(t):
    return t.jobs.select("id", F.size(stages.path_for("file_type")).alias("n_steps"), stages.next_step("current_step").alias("next_step"))


_EMAIL_OK = '{"status":"Phishing","confidence":0.9,"summary":"lure"}'
_REPORT_OK = """```json
{"risk_score":6.0,"severity":"High","summary_markdown":"s","summary":"s","mitre_techniques":["T1566"],"recommended_actions":["a"],"evidence_trail":[{"claim":"c","source":"s"}]}
```"""
_REPORT_BAD = _REPORT_OK.replace("High", "Low")
# What a job gets by its number: (kind, answer, minutes after the job, batch). Batch 1 holds the jobs, but for case 4.
_ANSWERS = {
    1: [("email_analysis", _EMAIL_OK, 5, 2), ("synthesis", _REPORT_OK, 10, 2)],
    2: [("email_analysis", "no idea", 5, 2), ("email_analysis", _EMAIL_OK, 10, 2), ("synthesis", _REPORT_BAD, 20, 3), ("synthesis", _REPORT_OK, 25, 3)],
    3: [("email_analysis", "{", 5, 2), ("email_analysis", "", 6, 3), ("synthesis", "{}", 5, 2), ("synthesis", _REPORT_BAD, 6, 3)],
    4: [("email_analysis", _EMAIL_OK, -2, 1), ("synthesis", _REPORT_OK, -1, 1)],
    5: [("email_analysis", _EMAIL_OK, 5, 2)],
    6: [("email_analysis", _EMAIL_OK, 5, 2), ("synthesis", _REPORT_BAD, 10, 3)],
    7: [("email_analysis", _EMAIL_OK, 90, 3), ("synthesis", _REPORT_OK, 91, 3)],
}


@query("t5_resume", f"""WITH {JOB_CTE}, j AS (SELECT id, CAST(id AS BIGINT) % 8 AS k, file_type = 'Eml' AS mail FROM jobs)
  SELECT id AS job_id, CASE WHEN k IN (1, 2, 4) THEN 'done' ELSE 'tier2.failed' END AS step,
  CAST(CASE WHEN k IN (0, 7) THEN 1 WHEN k = 1 OR k = 4 OR k = 5 THEN CASE WHEN mail THEN 2 ELSE 1 END WHEN k = 2 THEN CASE WHEN mail THEN 4 ELSE 2 END
    WHEN k = 3 THEN 2 ELSE CASE WHEN mail THEN 3 ELSE 2 END END AS BIGINT) AS prompts,
  CASE WHEN k IN (1, 2, 4) THEN NULL WHEN k = 3 THEN CASE WHEN mail THEN 'No usable email analysis.' ELSE 'No answer satisfied the report contract.' END
    WHEN k IN (0, 7) AND mail THEN 'No answer for email_analysis in time.' ELSE 'No answer for synthesis in time.' END AS error_message
  FROM j""")
def _(t):
    """Jobs wait for answers that come in later batches, earlier, twice, broken, too late or never; jobs are redelivered."""
    k = F.col("job_id").cast("bigint") % 8
    jobs = spread(t.jobs.select(F.col("id").alias("job_id"), "file_type", (
        F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("bigint") % 60)).alias("created_at")))
    path = scratch_path(t.spark, "messages")
    def batch(n: int) -> DataFrame:
        asked = J.job_messages(jobs if n == 2 else jobs.where(k != 4) if n == 1 else jobs.limit(0))
        for kind in ("email_analysis", "synthesis"):
            given = F.array().cast("array<struct<response:string,minutes:int>>")
            for case, answers in _ANSWERS.items():
                mine = [F.struct(F.lit(text).alias("response"), F.lit(m).alias("minutes")) for c, text, m, b in answers if (c, b) == (kind, n)]
                given = F.when(k == case, F.array(*mine) if mine else given).otherwise(given) if mine else given
            rows = jobs.select("job_id", "created_at", F.explode(given).alias("a")).select(
                "job_id", "a.response", (F.col("created_at") + F.make_dt_interval(mins=F.col("a.minutes"))).alias("at"))
            asked = asked.unionByName(J.answer_messages(rows, kind))
        return asked
    for n in (1, 2, 3):
        batch(n).write.parquet(f"{path}/{n}")
    # Time goes on: a later message lets the watermark pass the last deadlines.
    J.job_messages(jobs.select(F.lit("later").alias("job_id"), "file_type", F.lit("2024-01-02").cast("timestamp").alias("created_at")).limit(1)).write.parquet(f"{path}/4")
    moves = scratch_path(t.spark, "moves")
    checkpoint = scratch_path(t.spark, "moves-checkpoint")
    for n in (1, 2, 3, 4):  # the stream is stopped after every batch and resumes from its checkpoint
        seen = "{" + ",".join(map(str, range(1, n + 1))) + "}"
        stream = t.spark.readStream.schema(J.MESSAGE).parquet(f"{path}/{seen}")
        q = J.run_jobs(stream).writeStream.format("parquet").option("path", moves).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return J.current_states(t.spark.read.schema(J.MOVE).parquet(moves)).where("job_id <> 'later'")


_LIMIT = 2


@query("t6_limit_breaches", f"""WITH {LOG_CTE} SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, event_name, count(*) AS n, count(*) - {_LIMIT} AS rejected
  FROM logs GROUP BY ALL HAVING count(*) > {_LIMIT}""")
def _(t):
    hits = windows.limit_breaches(t.logs, _LIMIT, "1 hour", ip="event_name")
    return hits.select(epoch_seconds("window_start").alias("window_start"), F.col("source_ip").alias("event_name"), "n", "rejected")


@query("t6_limit_breach_stream", f"""WITH {LOG_CTE}, w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, event_name, count(*) AS n FROM logs GROUP BY ALL HAVING count(*) > {_LIMIT})
  SELECT CAST(epoch(b) AS BIGINT) AS window_start, event_name, n FROM w""")
def _(t):
    """The same as a stream: breaches are told as they happen, also in the windows that are still open at the end."""
    logs = _StreamLens(t.spark, t.folder).logs.withColumn("ts", F.col("ts").cast("timestamp"))
    hits = windows.limit_breaches(logs, _LIMIT, "1 hour", ip="event_name")
    stored = windows.latest(run_to_table(hits, "breaches", "update"))
    return stored.select(epoch_seconds("window_start").alias("window_start"), F.col("source_ip").alias("event_name"), "n")


@query("t6_rejected_requests", f"""WITH {LOG_CTE} SELECT event_id, event_name FROM (SELECT event_id, event_name, row_number() OVER (PARTITION BY event_name, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) AS nth FROM logs) WHERE nth > {_LIMIT}""")
def _(t):
    return windows.rejected_requests(t.logs, _LIMIT, 3600, ip="event_name").select("event_id", "event_name")


@query("t7_rolling_24h", """WITH h AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, count(*) AS c FROM events GROUP BY ALL),
  e AS (SELECT b + INTERVAL '1 hour' * (i + 1) AS w, c FROM h, range(24) r(i)) SELECT CAST(epoch(w) AS BIGINT) AS window_end, CAST(sum(c) AS BIGINT) AS n FROM e GROUP BY w""")
def _(t):
    r = windows.rolling_counts(t.table("events"), "ts")
    return r.select(epoch_seconds("window_end").alias("window_end"), "n")


@query("t8_cache_stream", f"""WITH {LOG_CTE}, {_LOOK} SELECT event_id, arg_max(c.malicious_score, c.looked_up_at) AS malicious_score, CAST(arg_max(c.from_live_api, c.looked_up_at) AS INT) AS from_live_api
  FROM asks a JOIN cache c ON a.value = c.value AND c.looked_up_at <= a.at AND c.looked_up_at > a.at - INTERVAL 24 HOUR GROUP BY event_id""")
def _(t):
    """The lookups of ``j6_cache_as_of`` with the cache as state of a stream: those that find an answer."""
    from .catalog_intel import cache
    live = _StreamLens(t.spark, t.folder)
    asks = live.logs.filter("event_type = 'click'").select(
        F.col("event_id").alias("lookup_id"), F.lit("Ip").alias("type"), F.col("source_ip").alias("value"), F.lit("VirusTotal").alias("source"),
        F.col("ts").cast("timestamp").alias("at"))
    known = cache(live).withColumn("looked_up_at", F.col("looked_up_at").cast("timestamp"))
    found = run_to_table(C.run_cache(C.answers(known).unionByName(C.lookups(asks))), "cache")
    return found.select(F.col("lookup_id").alias("event_id"), "malicious_score", F.col("from_live_api").cast("int").alias("from_live_api"))


@query("t8_cache_expiry", f"""WITH {LOG_CTE} SELECT CAST(ts AS DATE)::STRING AS day, count(DISTINCT source_ip) AS n_cached FROM logs
  WHERE event_type IN ('view', 'signup') AND source_ip <> '' GROUP BY ALL""")
def _(t):
    """Cached addresses by the day after which they expire: the time limit is a filter on the table."""
    from .catalog_intel import cache
    rows = cache(t).filter(F.col("value") != "")
    return rows.groupBy(F.to_date("looked_up_at").cast("string").alias("day")).agg(F.count_distinct("value").alias("n_cached"))

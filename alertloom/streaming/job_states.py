"""The second tier of every job as a state machine that waits for model answers.

A suspicious job asks for what its path needs: mails for an analysis first, all jobs for a synthesis. It waits at
``tier2.email_analysis`` or ``tier2.synthesis_pending`` until the answer arrives, in whichever batch that is, and goes on
from there. An unusable first answer asks again, a second one ends the job, and so does a deadline without an answer.
Answers that come before their job are kept until it arrives; redelivered jobs and further answers change nothing.

Jobs are dealt to SHARDS shards by a hash of their id. State is one value per shard with the jobs in it, and one timer
for the earliest of their deadlines: a batch calls the state store per shard, not several times per job. Ended jobs keep
their end only, so that redeliveries are known, until ``forget_after`` has passed. Time is event time: deadlines fall
when the watermark passes them.
"""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import responses, scoring
from ..functions.text import let

#: Messages: ``kind`` is job, email_analysis or synthesis; ``usable`` and ``violations`` say what an answer is worth.
MESSAGE = "job_id string, kind string, file_type string, usable boolean, violations array<string>, at timestamp"
#: What a job did: the step it is at, which prompt it sent (null: none) and which attempt that is, and why it failed.
MOVE = "job_id string, ord int, step string, prompt string, attempt int, error_message string, at timestamp"
WATERMARK = "10 minutes"
#: Fixed for the life of a checkpoint.
SHARDS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_WAITS = {"email_analysis": "tier2.email_analysis", "synthesis": "tier2.synthesis_pending"}
# Messages of failed jobs.
_FAILED = {"email_analysis": "No usable email analysis.", "synthesis": "No answer satisfied the report contract."}


def job_messages(jobs: DataFrame, at: str = "created_at") -> DataFrame:
    """Suspicious jobs (job_id, file_type, ...) as messages."""
    none = lambda kind: F.lit(None).cast(kind)
    return jobs.select("job_id", F.lit("job").alias("kind"), "file_type", none("boolean").alias("usable"),
                       none("array<string>").alias("violations"), F.col(at).alias("at"))


def answer_messages(answers: DataFrame, kind: str, at: str = "at") -> DataFrame:
    """Model answers (job_id, response, at) as messages; they are parsed and validated here, outside of any state."""
    # Each answer is parsed once: what is made of it hangs on one bound value.
    if kind == "email_analysis":
        worth = F.struct(responses.email_analysis("response").isNotNull().alias("usable"), F.array().cast("array<string>").alias("violations"))
    else:
        violations = let(responses.synthesis("response"), lambda r: F.when(
            r.isNull(), F.array(F.lit("The response is not the JSON object asked for."))).otherwise(
            scoring.report_violations(r["risk_score"], r["severity"], r["mitre"], F.size(r["evidence"]))))
        worth = let(violations, lambda v: F.struct((F.size(v) == 0).alias("usable"), v.alias("violations")))
    return answers.select("job_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file_type"),
                          worth.alias("worth"), F.col(at).alias("at")).select(
        "job_id", "kind", "file_type", "worth.usable", "worth.violations", "at")


class JobMachine(StatefulProcessor):
    """The jobs of a shard, each {"step", "wait", "attempt", "ord", "early", "timer"}."""

    def __init__(self, patience: dt.timedelta, forget_after: dt.timedelta, attempts: int = 2):
        self.patience, self.forget_after, self.attempts = patience, forget_after, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("shard", "state string")

    def _timer(self, job: dict, at_ms: int) -> None:
        job["timer"] = at_ms

    def _wait(self, job: dict, kind: str, attempt: int, at: pd.Timestamp) -> tuple:
        job |= {"step": _WAITS[kind], "wait": kind, "attempt": attempt, "until": int((at + self.patience).timestamp() * 1000)}
        self._timer(job, job["until"])
        return job["step"], kind, attempt, None, at

    def _end(self, job: dict, step: str, error: str | None, at: pd.Timestamp) -> tuple:
        job |= {"step": step, "wait": None, "early": []}
        self._timer(job, int((at + self.forget_after).timestamp() * 1000))
        return step, None, None, error, at

    def _late(self, job: dict) -> tuple:
        at = pd.Timestamp(job["until"], unit="ms")
        return self._end(job, "tier2.failed", f"No answer for {job['wait']} in time.", at)

    def _answer(self, job: dict, kind: str, usable: bool, at: pd.Timestamp):
        if job.get("wait") != kind:
            return
        if int(at.timestamp() * 1000) > job["until"]:
            yield self._late(job)  # whether the timer or the answer is handled first makes no difference
        elif usable:
            yield self._wait(job, "synthesis", 1, at) if kind == "email_analysis" else self._end(job, "done", None, at)
        elif job["attempt"] < self.attempts:
            yield self._wait(job, kind, job["attempt"] + 1, at)
        else:
            yield self._end(job, "tier2.failed", _FAILED[kind], at)

    def _moves(self, job: dict, messages: list):
        for m in messages:
            if m.kind == "job":
                if job.get("step"):
                    continue  # redelivered
                yield self._wait(job, "email_analysis" if m.file_type == "Eml" else "synthesis", 1, m.at)
                early, job["early"] = job.get("early", []), []
                # Answers that were here first, in the order in which the job asks for them.
                for kind in ("email_analysis", "synthesis"):
                    for k, usable, at in early:
                        if k == kind:
                            yield from self._answer(job, k, usable, max(m.at, pd.Timestamp(at, unit="ms")))
            elif not job.get("step"):
                early = job.setdefault("early", [])
                if sum(k == m.kind for k, _, _ in early) < self.attempts:  # no more than these can count
                    early.append((m.kind, bool(m.usable), int(m.at.timestamp() * 1000)))
                self._timer(job, int((m.at + self.forget_after).timestamp() * 1000))
            else:
                yield from self._answer(job, m.kind, bool(m.usable), m.at)

    def _tell(self, key: str, job: dict, moves) -> list[tuple]:
        rows = []
        for step, prompt, attempt, error, at in moves:
            job["ord"] = job.get("ord", 0) + 1
            rows.append((key, job["ord"], step, prompt, attempt, error, at))
        return rows

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*rows))
        return pd.DataFrame({
            "job_id": cols[0], "ord": np.array(cols[1], np.int32), "step": cols[2], "prompt": cols[3],
            "attempt": pd.array(cols[4], "Int32"), "error_message": cols[5], "at": cols[6]})

    def _load(self) -> tuple[str, dict]:
        text = self.shard.get()[0] if self.shard.exists() else "{}"
        return text, json.loads(text)

    def _store(self, before: str, jobs: dict, timer: int | None) -> None:
        """Keep the jobs, and a timer for the first deadline instead of ``timer``."""
        after = json.dumps(jobs)
        if not jobs:
            self.shard.clear()
        elif after != before:
            self.shard.update((after,))
        first = _first(jobs)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues):
        before, jobs = self._load()
        timer, out = _first(jobs), []
        messages: dict[str, list] = {}
        for part in rows:
            for m in part.itertuples(index=False):
                messages.setdefault(m.job_id, []).append(m)
        for job_id, mine in messages.items():
            mine.sort(key=lambda m: (m.at, m.kind, bool(m.usable)))
            job = jobs.setdefault(job_id, {})
            out += self._tell(job_id, job, self._moves(job, mine))
        self._store(before, jobs, timer)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs())
        before, jobs = self._load()
        out = []
        for job_id in [j for j, job in jobs.items() if job["timer"] <= now]:
            if jobs[job_id].get("wait"):
                out += self._tell(job_id, jobs[job_id], [self._late(jobs[job_id])])
            else:
                del jobs[job_id]
        self._store(before, jobs, None)  # the timer has just fired
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def _first(jobs: dict) -> int | None:
    return min((job["timer"] for job in jobs.values()), default=None)


def run_jobs(messages: DataFrame, patience: dt.timedelta = dt.timedelta(hours=1),
             forget_after: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """Moves of all jobs from a stream of messages."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    usable = messages.where("job_id is not null and at is not null").withColumn("shard", F.pmod(F.xxhash64("job_id"), F.lit(SHARDS)))
    return usable.withWatermark("at", WATERMARK).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=JobMachine(patience, forget_after), outputStructType=MOVE, outputMode="append", timeMode="EventTime")


def current_states(moves: DataFrame) -> DataFrame:
    """(job_id, step, prompts, error_message): where each job is now and how often it asked."""
    last = F.max_by(F.struct("step", "error_message"), "ord")
    return moves.groupBy("job_id").agg(last.alias("last"), F.count("prompt").alias("prompts")).select(
        "job_id", "last.step", "prompts", "last.error_message")

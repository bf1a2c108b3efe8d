"""The intel cache as keyed state of a stream: answers are kept for their time to live, lookups see the newest one.

A lookup at t gets the newest answer for its (type, value, source) that is not younger than t and not as old as t minus
the time to live, as the table form (``operators.intel.cached_as_of``) gives it. State is split by periods as long as
the time to live: an answer is sent to its own period and the next one, a lookup to its own, so that one busy address is
spread over as many keys as there are periods, and a key holds one period's answers. Of equal moments the answer with
the larger score counts, as in the table form. A key is forgotten when the watermark has passed its period.

Within a batch rows are handled in order of time. A lookup that arrives before an older answer does not see it: what was
answered stays answered. Null values and moments take no part.
"""

from __future__ import annotations

import json
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .job_states import STATE_STORE, WATERMARK

TTL = timedelta(hours=24)
KEY = ("type", "value", "source")
#: Answers have a score, lookups an id.
MESSAGE = "type string, value string, source string, at timestamp, malicious_score double, from_live_api boolean, lookup_id long"
FOUND = "lookup_id long, type string, value string, source string, malicious_score double, from_live_api boolean, looked_up_at timestamp"


def answers(rows: DataFrame) -> DataFrame:
    """Messages from answers (type, value, source, malicious_score, from_live_api, looked_up_at)."""
    return rows.select(*KEY, F.col("looked_up_at").alias("at"), "malicious_score", "from_live_api", F.lit(None).cast("long").alias("lookup_id"))


def lookups(rows: DataFrame) -> DataFrame:
    """Messages from lookups (lookup_id, type, value, source, at)."""
    return rows.select(*KEY, "at", F.lit(None).cast("double").alias("malicious_score"), F.lit(None).cast("boolean").alias("from_live_api"), "lookup_id")


class Cache(StatefulProcessor):
    """One key and period: the answers that a lookup of the period may still see, oldest first."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "answers string")

    def handleInputRows(self, key, rows, timerValues):
        kept = json.loads(self.kept.get()[0]) if self.kept.exists() else []
        period = int(key[3])
        batch = pd.concat(list(rows))
        batch = batch.assign(us=batch["at"].astype("datetime64[us]").astype("int64"), ask=batch["lookup_id"].notna())
        told = batch[~batch["ask"]].sort_values("us", kind="stable")
        kept += [[us, score, bool(live)] for us, score, live in zip(told["us"].tolist(), told["malicious_score"].tolist(), told["from_live_api"])]
        kept.sort(key=lambda a: (a[0], a[1]))
        # The newest answer at each lookup: later ones of the batch are sorted behind it.
        asked = batch[batch["ask"]].sort_values("us", kind="stable")
        at = np.searchsorted(np.array([a[0] for a in kept], np.int64), asked["us"].to_numpy(np.int64), side="right") - 1
        out = [(int(ask), *key[:3], kept[i][1], kept[i][2], pd.Timestamp(kept[i][0], unit="us"))
               for ask, us, i in zip(asked["lookup_id"].tolist(), asked["us"].tolist(), at.tolist()) if i >= 0 and kept[i][0] > us - self.ttl]
        # Of the answers before the period only the newest can still be the newest of a lookup.
        begin = period * self.ttl
        old = [a for a in kept if a[0] < begin]
        self.kept.update((json.dumps(old[-1:] + [a for a in kept if a[0] >= begin]),))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((begin + self.ttl) // 1000)
        yield pd.DataFrame(out, columns=["lookup_id", "type", "value", "source", "malicious_score", "from_live_api", "looked_up_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def run_cache(messages: DataFrame, ttl: timedelta = TTL) -> DataFrame:
    """Answers found for the lookups of a stream of messages; a lookup without one gives no row."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    us = int(ttl.total_seconds() * 1_000_000)
    period = F.floor(F.unix_micros("at") / us).cast("long")
    own = messages.where("type is not null and value is not null and source is not null and at is not null").withColumn("at", F.col("at").cast("timestamp"))
    spread = own.withColumn("period", F.explode(F.when(F.col("lookup_id").isNull(), F.array(period, period + 1)).otherwise(F.array(period))))
    return spread.withWatermark("at", WATERMARK).groupBy(*KEY, "period").transformWithStateInPandas(
        statefulProcessor=Cache(us), outputStructType=FOUND, outputMode="append", timeMode="EventTime")

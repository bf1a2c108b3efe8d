"""Registered queries on scoring, reports, model answers, prompts, similarity and the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, responses, scoring, vectors
from ..functions.email import TRUNCATED
from ..operators import incident_vectors as V
from ..operators import phishing_model as M
from ..operators import report, similarity
from ..operators.similar_index import SimilarIndex
from ..session import materialize, scratch_path
from .catalog_email import _KEYWORD_LIST, _TXT, MAIL_CTE
from .catalog_intel import EVIDENCE_CTE, bundles, tier1_rows
from .lens import REPORT_CTE, Lens, query

_EV = f"WITH {EVIDENCE_CTE}"
# Half to even on the scaled value, the way the figure is defined.
_RISK = """round_even(greatest(0.0::DOUBLE, least(10.0::DOUBLE, risk_score / 100.0::DOUBLE * 4.0::DOUBLE
  + coalesce(ml_score, 0.0::DOUBLE) * 3.0::DOUBLE + coalesce(max_intel, 0.0::DOUBLE) * 2.0::DOUBLE)) * 10, 0) / 10"""
_BAND = "CASE WHEN risk < 2.5 THEN 'Low' WHEN risk < 5.0 THEN 'Medium' WHEN risk < 7.5 THEN 'High' ELSE 'Critical' END"
_SCORED = f"""{_EV}, scored AS (SELECT *, {_RISK} AS risk, coalesce(n_iocs, 0) AS ni, coalesce(n_activity, 0) AS na FROM tier1
  LEFT JOIN per_job USING (job_id) LEFT JOIN per_act USING (job_id))"""


@query("r1_risk_score", f"{_SCORED} SELECT job_id, risk AS risk_score FROM scored")
def _(t):
    b = bundles(t)
    risk = scoring.risk_score(F.col("rule_score"), F.col("ml_score"), report.max_intel(F.col("iocs")), F.lit(False))
    return b.select("job_id", risk.alias("risk_score"))


@query("r2_severity_band", f"WITH {REPORT_CTE} SELECT job_id, {_BAND.replace('risk', 'risk_score')} AS band FROM reports")
def _(t):
    return t.reports.select("job_id", scoring.severity_band("risk_score").alias("band"))


_ANY = lambda *ps: "(" + " OR ".join(f"len(list_filter(matched_rules, lambda r: starts_with(r, '{p}'))) > 0" for p in ps) + ")"
_PLAIN = "len(list_filter(matched_rules, lambda r: NOT contains(r, ':'))) > 0"
_MITRE = f"""CASE WHEN file_type = 'Eml' THEN CASE
    WHEN coalesce(has_url, false) AND ({_PLAIN} OR {_ANY('suspicious_domain', 'lookalike_domain')}) THEN 'T1566.002|T1566'
    WHEN coalesce(has_url, false) THEN 'T1566.002' ELSE 'T1566' END
  ELSE coalesce(nullif(concat_ws('|', CASE WHEN {_ANY('recon_burst', 'access_denied')} THEN 'T1087' END,
    CASE WHEN {_ANY('high_risk_api:DeleteTrail', 'high_risk_api:StopLogging', 'high_risk_api:UpdateTrail', 'high_risk_api:PutEventSelectors')} THEN 'T1562.008'
      WHEN {_ANY('high_risk_api')} THEN 'T1098' END,
    CASE WHEN {_ANY('sensitive_event_unseen_ip', 'user_event_count_anomaly', 'ip_event_count_anomaly', 'user_event_frequency_spike', 'ip_event_frequency_spike')} THEN 'T1078' END), ''), 'T1078') END"""


@query("r3_mitre_mapping", f"{_SCORED} SELECT job_id, {_MITRE} AS mitre FROM scored")
def _(t):
    b = bundles(t)
    return b.select("job_id", F.array_join(report.mitre(F.col("artifact_type"), F.col("iocs"), F.col("matched_rules")), "|").alias("mitre"))


_LIVE = "CASE WHEN live THEN 'live API' ELSE 'heuristic analysis only' END"
_LINES = f"""ioc_line AS (SELECT job_id, pos, type, value, concat('  - `', type, '` `', value, '` (Rule) — ',
    coalesce(string_agg(concat(source, ' score ', printf('%.2f', score), ' (', {_LIVE}, ')'), '; ' ORDER BY source) FILTER (WHERE source IS NOT NULL), 'not enriched')) AS line
  FROM joined GROUP BY job_id, pos, type, value), ioc_lines AS (SELECT job_id, string_agg(line, chr(10) ORDER BY pos, type, value) AS lines FROM ioc_line GROUP BY job_id)"""


@query("r4_summary", f"""{_SCORED}, {_LINES} SELECT job_id, concat_ws(chr(10), '[generated without LLM]', '', '## Incident summary (rule-based, no LLM synthesis)', '',
  concat('- Artifact: `', file_name, '` (', file_type, ')'),
  concat('- Tier 1 verdict: **', verdict, '** (rule score ', risk_score, '/100', CASE WHEN ml_score IS NULL THEN '' ELSE concat(', ML phishing probability ', printf('%.3f', ml_score)) END, ')'),
  concat('- Matched rules: ', array_to_string(list_transform(matched_rules, lambda r: concat('`', r, '`')), ', ')),
  concat('- IOCs: ', ni, ' (', coalesce(n_intel, 0), ' threat intel lookups)'), lines,
  CASE WHEN na > 0 THEN concat('- Correlated CloudTrail events: ', na, ' (source IP matches an IOC)') END, '',
  concat('**Risk score: ', printf('%.1f', risk), '/10 — severity: ', {_BAND}, '**'), '',
  '{report.NO_MODEL_NOTE}', '') AS summary
  FROM scored LEFT JOIN ioc_lines USING (job_id)""")
def _(t):
    return report.deterministic_reports(bundles(t)).select("job_id", "summary")


_ACTIONS = lambda xs: " || '|' || ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query("r5_actions", f"""{_SCORED} SELECT job_id, CASE WHEN file_type = 'Eml' THEN {_ACTIONS(report.EMAIL_ACTIONS)} ELSE {_ACTIONS(report.LOG_ACTIONS)} END
  || CASE WHEN na > 0 THEN '|{report.CORRELATED_ACTION}' ELSE '' END AS actions FROM scored""")
def _(t):
    return bundles(t).select("job_id", F.array_join(report.actions(F.col("artifact_type"), F.col("activity")), "|").alias("actions"))


@query("r6_evidence_trail", f"""{_SCORED}, trail AS (
  SELECT job_id, 0 AS o, 0 AS pos, '' AS a, '' AS b, '' AS c, concat('Tier 1 verdict ', verdict, ' with rule score ', risk_score, '/100; matched rules: ', array_to_string(matched_rules, ', ')) AS claim, 'tier1.rule_check_results' AS source FROM scored
  UNION ALL SELECT job_id, 1, 0, '', '', '', concat('ML phishing probability ', printf('%.3f', ml_score), '.'), 'ml_score' FROM scored WHERE ml_score IS NOT NULL
  UNION ALL SELECT job_id, 2, pos, type, value, source, concat(type, ' ', value, ' scored ', printf('%.2f', score), ' by ', source, ' (', {_LIVE}, ').'), concat('intel:', source) FROM joined WHERE source IS NOT NULL
  UNION ALL SELECT job_id, 3, rn, '', '', '', concat('CloudTrail event ', event_name, ' from ', source_ip, ' by ', user_name, ' at ', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0+00:00.'), 'cloudtrail' FROM near
  UNION ALL SELECT job_id, 4, 0, '', '', '', concat('Deterministic risk score ', printf('%.1f', risk), '/10 (rule score, ML score, intel scores, email verdict).'), 'deterministic_scoring' FROM scored)
  SELECT job_id, string_agg(concat(source, ' <- ', claim), chr(10) ORDER BY o, pos, a, b, c) AS trail FROM trail GROUP BY job_id""")
def _(t):
    r = report.deterministic_reports(bundles(t))
    lines = F.transform("evidence", lambda e: F.concat(e["source"], F.lit(" <- "), e["claim"]))
    return r.select("job_id", F.array_join(lines, "\n").alias("trail"))


_TAMPER = f"""WITH {REPORT_CTE}, x AS (SELECT job_id, CAST(job_id AS BIGINT) AS j, CASE WHEN CAST(job_id AS BIGINT) % 17 = 0 THEN risk_score + 11 ELSE risk_score END AS risk,
    CASE WHEN CAST(job_id AS BIGINT) % 13 = 0 THEN 'Low' ELSE severity END AS severity,
    CASE WHEN json_valid(mitre_json) THEN CAST(json(mitre_json) AS VARCHAR[]) ELSE [] END AS mitre FROM reports),
  y AS (SELECT *, {_BAND} AS expected, regexp_replace(CAST(risk AS VARCHAR), '\\.0$', '') AS num FROM x)"""


@query("r7_validator", f"""{_TAMPER} SELECT job_id, concat_ws(chr(10),
  CASE WHEN risk < 0 OR risk > 10 THEN concat('risk_score ', num, ' is outside the 0-10 range.')
    WHEN expected <> severity THEN concat('severity ''', severity, ''' does not match risk_score ', num, ' (expected ''', expected, '''; bands: 0-2.49 low, 2.5-4.9 medium, 5-7.4 high, 7.5-10 critical).') END,
  CASE WHEN len(mitre) = 0 THEN 'mitre_techniques must not be empty — map the evidence to at least one ATT&CK technique.' END,
  nullif(array_to_string(list_transform(list_filter(mitre, lambda m: NOT regexp_matches(m, '^T\\d{{4}}(\\.\\d{{3}})?$')), lambda m: concat('mitre technique ''', m, ''' is not a valid ATT&CK technique id (expected Txxxx or Txxxx.yyy).')), chr(10)), ''),
  CASE WHEN j % 19 = 0 THEN 'evidence_trail must not be empty — every claim must link to its evidence source.' END) AS violations FROM y""")
def _(t):
    j = F.col("job_id").cast("bigint")
    v = scoring.report_violations(
        F.when(j % 17 == 0, F.col("risk_score") + 11).otherwise(F.col("risk_score")),
        F.when(j % 13 == 0, "Low").otherwise(F.col("severity")),
        responses.json_strings("mitre_json"), F.when(j % 19 == 0, 0).otherwise(1),
    )
    return t.reports.select("job_id", F.array_join(v, "\n").alias("violations"))


# --- model answers ----------------------------------------------------------------------------------

_KIND = "(conv_id * 3 + turn) % 9"


def email_answers(t: Lens) -> DataFrame:
    """Conversation turns as answers of a model: attempt = turn + 1, in several more or less valid shapes."""
    kind = F.expr(_KIND)
    status = F.when(kind == 4, "maybe").when(kind == 6, "SAFE").otherwise("Phishing")
    body = F.to_json(F.struct(
        status.alias("status"),
        F.when(kind != 7, F.col("turn") * 0.4 - 0.2).alias("confidence"),
        F.array(
            F.struct(F.lit("URL").alias("type"), F.concat(F.lit(" http://c"), F.col("conv_id").cast("string"), F.lit(" ")).alias("value")),
            F.struct(F.lit("planet").alias("type"), F.lit("x").alias("value")),
            F.struct(F.lit("Ip").alias("type"), F.lit("  ").alias("value")),
        ).alias("iocs"),
        F.array(F.lit("urgency"), F.lit(" "), F.col("role")).alias("phishing_indicators"),
        F.when(kind == 5, "   ").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("summary"),
    ))
    fence = "`" * 3
    text = (
        F.when(kind == 0, F.concat(F.lit(f"Sure:\n{fence}json\n"), body, F.lit(f"\n{fence}\nbye }}")))
        .when(kind == 1, F.concat(F.lit("Here: "), body, F.lit(" Regards")))
        .when(kind == 2, F.lit("no object in here"))
        .when(kind == 3, F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(",}")))
        .when(kind == 6, F.concat(F.lit("/* note */"), F.replace(F.replace(body, F.lit('"status"'), F.lit('"STATUS"')), F.lit('"summary"'), F.lit('"Summary"'))))
        .when(kind == 8, F.substr(body, F.lit(1), F.length(body) - 1))
        .otherwise(body)
    )
    return t.table("conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), (F.col("turn") + 1).cast("int").alias("attempt"), text.alias("response"), "role", "text",
    )


_TRIM = "trim(text, concat(' ', chr(9), chr(10), chr(13)))"
_ANSWERS = f"""WITH e AS (SELECT CAST(conv_id AS STRING) AS job_id, CAST(turn + 1 AS INT) AS attempt, {_KIND} AS kind,
  {_KIND} NOT IN (2, 4, 5, 8) AS ok, CASE WHEN {_KIND} = 6 THEN 'Safe' ELSE 'Phishing' END AS status,
  CASE WHEN {_KIND} = 7 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, turn * 0.4::DOUBLE - 0.2::DOUBLE)) END AS confidence,
  concat('http://c', conv_id) AS url, concat('urgency|', role) AS indicators, {_TRIM} AS summary FROM conversations)"""


@query("r8_email_answers", f"""{_ANSWERS} SELECT job_id, attempt, CASE WHEN ok THEN status END AS status, CASE WHEN ok THEN round(confidence, 9) END AS confidence,
  CASE WHEN ok THEN concat('Url ', url) END AS iocs, CASE WHEN ok THEN indicators END AS indicators, CASE WHEN ok THEN summary END AS summary FROM e""")
def _(t):
    p = email_answers(t).select("job_id", "attempt", responses.email_analysis("response").alias("a"))
    return p.select(
        "job_id", "attempt", "a.status", F.round("a.confidence", 9).alias("confidence"),
        F.array_join(F.transform("a.iocs", lambda i: F.concat(i["type"], F.lit(" "), i["value"])), "|").alias("iocs"),
        F.array_join("a.phishing_indicators", "|").alias("indicators"), "a.summary",
    )


def synthesis_answers(t: Lens) -> DataFrame:
    kind = F.expr(_KIND)
    body = F.to_json(F.struct(
        F.when(kind != 4, F.col("turn") * 1.5).alias("risk_score"),
        F.when(kind == 5, "dire").when(F.col("turn") * 1.5 < 2.5, "LOW").when(F.col("turn") * 1.5 < 5, "medium")
        .when(F.col("turn") * 1.5 < 7.5, "High").otherwise("critical").alias("severity"),
        F.concat(F.lit("\n"), F.col("text")).alias("summary_markdown"),
        F.array(F.lit(" T1566 "), F.lit(" ")).alias("mitre_techniques"),
        F.array(F.lit("act "), F.lit("")).alias("recommended_actions"),
        F.array(
            F.struct(F.lit(" c ").alias("claim"), F.col("role").alias("source")),
            F.struct(F.lit("x").alias("claim"), F.lit(" ").alias("source")),
        ).alias("evidence_trail"),
    ))
    text = F.when(kind == 2, "nothing").when(kind == 0, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body)
    return t.table("conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), (F.col("turn") + 1).cast("int").alias("attempt"), text.alias("response"))


_SYN = f"""WITH e AS (SELECT CAST(conv_id AS STRING) AS job_id, CAST(turn + 1 AS INT) AS attempt, {_KIND} NOT IN (2, 4, 5) AS ok,
  turn * 1.5::DOUBLE AS risk, role, {_TRIM} AS summary FROM conversations)"""


@query("r9_synthesis_answers", f"""{_SYN} SELECT job_id, attempt, CASE WHEN ok THEN risk END AS risk_score, CASE WHEN ok THEN {_BAND} END AS severity,
  CASE WHEN ok THEN summary END AS summary, CASE WHEN ok THEN 'T1566' END AS mitre, CASE WHEN ok THEN 'act' END AS actions,
  CASE WHEN ok THEN concat('c <- ', role) END AS evidence FROM e""")
def _(t):
    p = synthesis_answers(t).select("job_id", "attempt", responses.synthesis("response").alias("a"))
    return p.select(
        "job_id", "attempt", "a.risk_score", "a.severity", "a.summary", F.array_join("a.mitre", "|").alias("mitre"),
        F.array_join("a.actions", "|").alias("actions"),
        F.array_join(F.transform("a.evidence", lambda e: F.concat(e["claim"], F.lit(" <- "), e["source"])), "|").alias("evidence"),
    )


@query("r10_first_usable_attempt", f"""{_ANSWERS}, g AS (SELECT job_id, min(attempt) FILTER (WHERE ok) AS attempt, count(*) AS tried FROM e GROUP BY job_id)
  SELECT job_id, CASE WHEN g.attempt IS NULL THEN 'failed' ELSE 'accepted' END AS outcome, g.attempt, tried, e.status FROM g LEFT JOIN e USING (job_id, attempt)""")
def _(t):
    o = report.analysis_outcomes(email_answers(t).select("job_id", "attempt", "response"))
    return o.select("job_id", "outcome", "attempt", "tried", "analysis.status")


@query("r10_accepted_reports", f"""{_SYN}, g AS (SELECT job_id, min(attempt) FILTER (WHERE ok AND risk <= 10) AS attempt FROM e GROUP BY job_id)
  SELECT job_id, CASE WHEN g.attempt IS NULL THEN 'failed' ELSE 'accepted' END AS outcome, g.attempt, e.risk AS risk_score FROM g LEFT JOIN e USING (job_id, attempt)""")
def _(t):
    return report.synthesis_outcomes(synthesis_answers(t)).select("job_id", "outcome", "attempt", "report.risk_score")


_RULES_SHOWN = "CASE WHEN len(kw) > 0 THEN array_to_string(kw, ', ') ELSE 'none' END"


@query("r11_email_prompts", f"""WITH {MAIL_CTE}, k AS (SELECT doc_id, body, {_KEYWORD_LIST} AS kw FROM (SELECT doc_id, body, {_TXT} AS txt FROM mails))
  SELECT doc_id, concat('Analyze this email for phishing indicators.', chr(10), chr(10), 'Tier 1 static filter matched rules: ', {_RULES_SHOWN}, chr(10), chr(10),
   'Pre-computed tool output (parsed structure + extracted network entities):', chr(10), '{{}}', chr(10), chr(10), 'Email content (PII-redacted):', chr(10),
   body, chr(10), chr(10),
   'Provide your final analysis as the JSON object described in the system instructions.') AS prompt FROM k""")
def _(t):
    from ..functions.email import combined_text, keyword_rules
    m = t.mails.select("doc_id", "body", keyword_rules(combined_text("subject", "body")).alias("rules"))
    return m.select("doc_id", prompts.email_prompt("body", "rules", F.lit("{}")).alias("prompt"))


@query("r11_synthesis_prompts", f"""WITH {REPORT_CTE}, x AS (SELECT job_id, risk_score, severity, summary, CAST(job_id AS BIGINT) % 3 AS j FROM reports)
  SELECT job_id, concat('Synthesize the final incident report for this job.', chr(10), chr(10), 'Evidence bundle (all fields are observed data; reason only about these):', chr(10),
   summary, chr(10), CASE WHEN j = 0 THEN '' ELSE concat(chr(10), 'Similar past incidents (retrieved by embedding similarity — background', chr(10),
    'context only; never present their conclusions as observed facts of THIS job):', chr(10), '- risk ', printf('%.1f', risk_score), ' (', severity, '), similarity 0.88, rules: ',
    CASE WHEN j = 1 THEN 'none' ELSE 'r1, r2, r3, r4, r5, r6' END, chr(10), '  summary: ', summary, chr(10)) END, chr(10),
   'Provide the report as the JSON object described in the system instructions.') AS prompt FROM x""")
def _(t):
    j = F.col("job_id").cast("bigint") % 3
    similar = F.array(F.struct(
        "risk_score", "severity", F.lit(0.876).alias("similarity"), F.col("summary").alias("excerpt"),
        F.when(j == 1, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"r{i}") for i in range(1, 7)])).alias("matched_rules"),
    ))
    similar = F.filter(similar, lambda s: j != 0)
    return t.reports.select("job_id", prompts.synthesis_prompt("summary", similar).alias("prompt"))


@query("r12_rule_report_json", """WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)
  SELECT k AS o_orderkey, CASE WHEN k % 5 IN (0, 1) THEN NULL WHEN k % 5 = 2 THEN 'a' ELSE concat('a|', s) END AS rules,
  CAST(CASE WHEN k % 5 IN (0, 1) THEN NULL WHEN k % 5 = 2 THEN 0 ELSE k % 101 END AS INT) AS risk_score FROM b""")
def _(t):
    """Stored reports: corrupt, without extraction, with odd entries, and regular ones."""
    k = F.col("o_orderkey")
    js = (
        F.when(k % 5 == 0, "{broken").when(k % 5 == 1, '{"matchedRules":["a"]}')
        .when(k % 5 == 2, '{"matchedRules":[1,"a",null,{"x":"y"}],"riskScore":"7","extracted":{}}')
        .otherwise(F.concat(F.lit('{"matchedRules":["a","'), F.col("o_orderstatus"), F.lit('"],"riskScore":'), (k % 101).cast("string"), F.lit(',"extracted":{"urls":["u"]}}')))
    )
    r = t.table("orders").select("o_orderkey", responses.rule_report(js).alias("r"))
    return r.select("o_orderkey", F.array_join("r.matched_rules", "|").alias("rules"), "r.risk_score")


# --- classifier and vectors ---------------------------------------------------------------------------


@query("m1_classifier_text", "SELECT doc_id, concat(source, ' [SEP] ', text) AS text FROM documents")
def _(t):
    return t.table("documents").select("doc_id", M.classifier_text(F.col("source"), F.col("text")).alias("text"))


@query("m1_phishing_scores")
def _(t):
    """Train on the labelled documents and score all of them."""
    texts = t.table("documents").select("doc_id", M.classifier_text(F.col("source"), F.col("text")).alias("text"))
    labelled = texts.join(t.table("labels"), "doc_id").select("text", (F.col("toxic") > 0).cast("double").alias("label"))
    model = M.train(materialize(labelled, "train"))
    scored = M.score(model, texts)
    return scored.select("doc_id", "ml_score", scoring.verdict(F.lit(0), F.col("ml_score")).alias("verdict"))


@query("m2_softmax", """SELECT vec_id, round(exp(e[2] - m) / list_sum(list_transform(e, lambda x: exp(x - m))), 9) AS p
  FROM (SELECT vec_id, e, list_max(e) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 10) AS e FROM embeddings))""")
def _(t):
    logits = F.transform("embedding", lambda x: x.cast("double") * 10)
    return t.table("embeddings").select("vec_id", F.round(vectors.softmax_probability(logits), 9).alias("p"))


@query("m3_mean_pool", """WITH d AS (SELECT label, i AS dim, avg(embedding[i + 1]::DOUBLE) AS a FROM (SELECT label, embedding, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL),
  n AS (SELECT label, sqrt(sum(a * a)) AS n FROM d GROUP BY label) SELECT label, CAST(dim AS INT) AS dim, round(a / n, 6) AS x FROM d JOIN n USING (label)""")
def _(t):
    pooled = similarity.mean_pooled(t.table("embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


@query("m4_index_text", f"""{_EV}, v AS (SELECT job_id, string_agg(value, ', ' ORDER BY pos, type, value) AS vals FROM iocs GROUP BY job_id)
  SELECT job_id, CASE WHEN vals IS NULL THEN verdict ELSE concat(verdict, chr(10), 'IOCs: ', vals) END AS text FROM tier1 LEFT JOIN v USING (job_id)""")
def _(t):
    values = F.transform("iocs", lambda i: i["value"])
    return bundles(t).select("job_id", similarity.index_text(F.col("tier1_verdict"), values).alias("text"))


@query("m5_retrieval_text", f"""{_EV}, v AS (SELECT job_id, string_agg(value, chr(10) ORDER BY pos, type, value) AS vals FROM iocs GROUP BY job_id)
  SELECT job_id, concat_ws(chr(10), CASE WHEN CAST(job_id AS BIGINT) % 3 = 0 THEN 'mail summary' END, array_to_string(matched_rules, chr(10)), vals) AS text FROM tier1 LEFT JOIN v USING (job_id)""")
def _(t):
    values = F.transform("iocs", lambda i: i["value"])
    note = F.when(F.col("job_id").cast("bigint") % 3 == 0, "mail summary").otherwise(" ")
    return bundles(t).select("job_id", similarity.retrieval_text(F.col("matched_rules"), values, note).alias("text"))


def _vectors(t: Lens, id_name: str) -> DataFrame:
    e = t.table("embeddings")
    return e.select(F.col("vec_id").alias(id_name), F.col("vec_id").alias("owner"), "embedding")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("m6_similar_top3", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM s) SELECT query_id, id, similarity, CAST(rn AS INT) AS rn FROM r WHERE rn <= 3""")
def _(t):
    """Every stored vector searches the whole table; its own job is left out."""
    return similarity.top_similar(_vectors(t, "query_id"), _vectors(t, "id"), 3)


@query("m6_similar_incidents", f"""WITH {REPORT_CTE}, o AS (SELECT *, CAST(job_id AS BIGINT) AS j FROM reports),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS similarity, o.severity, o.risk_score, o.summary AS excerpt
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id JOIN o ON o.j = b.vec_id)
  SELECT query_id, id, similarity, severity, risk_score, excerpt FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 3""")
def _(t):
    """Every vector searches the stored index of the incidents that have a report."""
    reports = t.reports.withColumn("report_id", F.col("job_id").cast("bigint"))
    corpus = _vectors(t, "id").join(reports.select(F.col("report_id").alias("id")), "id", "left_semi")
    index = SimilarIndex(t.spark, scratch_path(t.spark, "incident-index"))
    index.create(corpus)
    index.append(corpus, 0)
    found = index.search(_vectors(t, "query_id"), 3)
    return similarity.attach_reports(found, reports, tier1_rows(t)).select("query_id", "id", "similarity", "severity", "risk_score", "excerpt")


_M4_TEXT = """texts AS (SELECT job_id, CASE WHEN vals IS NULL THEN verdict ELSE concat(verdict, chr(10), 'IOCs: ', vals) END AS text FROM tier1
  LEFT JOIN (SELECT job_id, string_agg(value, ', ' ORDER BY pos, type, value) AS vals FROM iocs GROUP BY job_id) USING (job_id))"""
_M5_TEXT = """questions AS (SELECT job_id, concat_ws(chr(10), array_to_string(matched_rules, chr(10)), vals) AS text FROM tier1
  LEFT JOIN (SELECT job_id, string_agg(value, chr(10) ORDER BY pos, type, value) AS vals FROM iocs GROUP BY job_id) USING (job_id))"""


def _buckets(texts: str, out: str) -> str:
    """Signed counts (job_id, b, x) per bucket of the texts."""
    return f"""{out} AS (SELECT job_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {V.DIMS} AS b,
      sum(CASE WHEN substr(md5(term), 9, 1) >= '8' THEN -1 ELSE 1 END) AS x, count(*) AS n
    FROM (SELECT job_id, unnest(regexp_extract_all(lower(text), '{V.TERM}')) AS term FROM {texts}) GROUP BY ALL)"""


def _weighted(buckets: str, out: str) -> str:
    """Unit vectors (job_id, b, w), their bucket weights fitted on the stored texts."""
    return f"""{out} AS (SELECT job_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY job_id)) AS w
    FROM (SELECT job_id, b, x * (ln((1 + (SELECT count(*) FROM texts)) / (1 + coalesce(df, 0))) + 1) AS w
      FROM {buckets} LEFT JOIN (SELECT b, count(*) AS df FROM stored_buckets GROUP BY b) d USING (b)) WHERE w <> 0)"""


_VECTOR_CTE = f"{_EV}, {_M4_TEXT}, {_buckets('texts', 'stored_buckets')}, {_weighted('stored_buckets', 'stored_vectors')}"


def _stored_texts(t: Lens) -> tuple[DataFrame, DataFrame]:
    """(job_id, text) that is stored and that is asked for, of the suspicious jobs."""
    b = materialize(bundles(t).select("job_id", "tier1_verdict", "matched_rules", F.transform("iocs", lambda i: i["value"]).alias("values")), "incident-texts")
    stored = b.select("job_id", similarity.index_text(F.col("tier1_verdict"), F.col("values")).alias("text"))
    asked = b.select("job_id", similarity.retrieval_text(F.col("matched_rules"), F.col("values"), F.lit(" ")).alias("text"))
    return stored, asked


@query("u2_incident_vectors", f"{_VECTOR_CTE} SELECT job_id, CAST(b AS INT) AS bucket, round(w, 6) AS weight FROM stored_vectors")
def _(t):
    """From index text to unit vectors: all buckets that are not 0."""
    texts, _ = _stored_texts(t)
    model = V.fit(texts)
    out = model.vectors(texts, "job_id")
    return out.select("job_id", F.posexplode("embedding").alias("bucket", "w")).where("w <> 0").select("job_id", "bucket", F.round("w", 6).alias("weight"))


@query("m6_retrieved_incidents", f"""{_VECTOR_CTE}, {_M5_TEXT}, {_buckets('questions', 'asked_buckets')}, {_weighted('asked_buckets', 'asked')},
  hits AS (SELECT a.job_id AS q, s.job_id AS id, sum(a.w * s.w) AS c FROM asked a JOIN stored_vectors s ON a.b = s.b AND a.job_id <> s.job_id GROUP BY ALL),
  pairs AS (SELECT q.job_id AS query_id, i.job_id AS id, round(coalesce(c, 0), 6) + 0.0 AS similarity
    FROM questions q JOIN texts i ON q.job_id <> i.job_id LEFT JOIN hits ON hits.q = q.job_id AND hits.id = i.job_id)
  SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rn
  FROM pairs QUALIFY rn <= 3""")
def _(t):
    """The whole way: texts of two batches become vectors in the stored index, every job asks with its rules and indicators."""
    stored, asked = _stored_texts(t)
    model = V.fit(stored)
    index = SimilarIndex(t.spark, scratch_path(t.spark, "incident-index"))
    rows = materialize(model.vectors(stored, "job_id").select(
        F.col("job_id").alias("id"), F.col("job_id").alias("owner"), "embedding"), "incident-vectors")
    index.create(rows)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    index.append(rows.where(half == 0), 0)
    index.append(rows.where(half == 1), 1)
    questions = model.vectors(asked, "job_id").select(F.col("job_id").alias("query_id"), F.col("job_id").alias("owner"), "embedding")
    return index.search(questions, 3)


_SCORE = "(doc_id % 100) / 100.0::DOUBLE"


@query("m7_agreement", f"""WITH s AS (SELECT {_SCORE} AS score, CASE WHEN toxic > 0 THEN least(1.0::DOUBLE, {_SCORE} + 0.1::DOUBLE) ELSE {_SCORE} END AS baseline FROM labels)
  SELECT count(*) AS n, count(*) FILTER (WHERE (score >= 0.7::DOUBLE) = (baseline >= 0.7::DOUBLE)) AS same_verdict, count(*) FILTER (WHERE abs(score - baseline) <= 0.05::DOUBLE) AS within_tolerance,
  count(*) FILTER (WHERE score >= 0.7::DOUBLE AND baseline >= 0.7::DOUBLE) AS both_flagged, count(*) FILTER (WHERE score >= 0.7::DOUBLE AND baseline < 0.7::DOUBLE) AS only_score,
  count(*) FILTER (WHERE score < 0.7::DOUBLE AND baseline >= 0.7::DOUBLE) AS only_baseline, count(*) FILTER (WHERE score < 0.7::DOUBLE AND baseline < 0.7::DOUBLE) AS neither,
  round(max(abs(score - baseline)), 9) AS max_delta FROM s""")
def _(t):
    score = F.col("doc_id") % 100 / 100.0
    base = F.when(F.col("toxic") > 0, F.least(F.lit(1.0), score + 0.1)).otherwise(score)
    a = M.agreement(t.table("labels").select(score.alias("score"), base.alias("baseline")), tolerance=0.05)
    return a.withColumn("max_delta", F.round("max_delta", 9))


@query("m8_pair_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    e = t.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pairs = e.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return similarity.pair_cosines(pairs, e).select("a", "b", F.round("cosine", 6).alias("cosine"))

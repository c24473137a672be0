"""Decision rules, evaluation summaries and cost roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.cleaning import FLAGS_SQL, RETRIEVAL_SQL
from riskloom.catalog.records import RECORDS, records
from riskloom.catalog.registry import query
from riskloom.catalog.texts import STORED, letter_store, letters_sql
from riskloom.operators import policy as pl
from riskloom.operators import similarity as sm
from riskloom.operators import usage as us
from riskloom.operators.assessment import assess_requests
from riskloom.operators.cleaning import quality_flags
from riskloom.plans.frames import written
from riskloom.schemas import REQUEST
from riskloom.sources.files import record_struct

_P = "round(((record_key * 7919) % 1009) / 1008.0::DOUBLE, 4)"
_BASE = f"""{RECORDS}, base AS (SELECT record_key, {_P} AS p, {_P} >= 0.5 AS pred, {FLAGS_SQL} AS flags,
        CASE WHEN record_key % 40 = 11 THEN 'timeout' WHEN record_key % 80 = 12 THEN '' END AS error FROM records),
    stub AS (SELECT record_key, error IS NOT NULL AS failed, CASE WHEN error IS NULL THEN p ELSE 0.5 END AS p, error IS NULL AND pred AS pred,
        CASE WHEN error IS NULL THEN flags ELSE []::VARCHAR[] END AS flags, error, coalesce(error <> '', FALSE) AS warned FROM base),
    conf AS (SELECT *, len(list_filter(flags, lambda f: f LIKE 'optional%')) > 0 AS opt,
        warned OR len(list_filter(flags, lambda f: f LIKE 'required%' OR f LIKE 'invalid%')) > 0 AS forced, abs(p - 0.5) AS m FROM stub),
    decided AS (SELECT *, CASE WHEN forced THEN 'low' WHEN m >= 0.3::DOUBLE THEN CASE WHEN opt THEN 'medium' ELSE 'high' END
        WHEN m >= 0.15::DOUBLE THEN CASE WHEN opt THEN 'low' ELSE 'medium' END ELSE 'low' END AS confidence FROM conf),
    gated AS (SELECT *, confidence = 'low' OR failed AS retrieve FROM decided)"""


def _scored(t):
    k = F.col("record_key")
    p = F.round(F.expr("(record_key * 7919) % 1009") / F.lit(1008.0), 4)
    return records(t).select(
        "record_key", "record_id", "risk_type", "territory", p.alias("probability_of_loss"), (p >= 0.5).alias("is_loss_making_prediction"),
        F.array(F.lit("premium_to_limit"), F.lit("log_limit")).alias("top_features"), quality_flags().alias("input_quality_flags"),
        F.array().cast("array<string>").alias("model_warnings"),
        F.when(k % 40 == 11, F.lit("timeout")).when(k % 80 == 12, F.lit("")).alias("prediction_error"),
    )


def _decided(t):
    return pl.with_decision(pl.with_prediction_stub(_scored(t)))


@query("pl1_confidence", f"WITH {_BASE} SELECT record_key, confidence AS confidence_level FROM gated")
def _(t):
    return _decided(t).select("record_key", "confidence_level")


@query(
    "pl2_risk_label",
    f"WITH {_BASE} SELECT record_key, CASE WHEN confidence = 'low' THEN 'unclear' WHEN pred THEN 'likely_loss' ELSE 'unlikely_loss' END AS risk_assessment FROM gated",
)
def _(t):
    label = pl.risk_label(F.col("is_loss_making_prediction"), F.col("confidence_level"))
    return _decided(t).select("record_key", label.alias("risk_assessment"))


@query("pl3_retrieval_gate", f"WITH {_BASE} SELECT record_key FROM gated WHERE retrieve")
def _(t):
    return _decided(t).where("retrieve").select("record_key")


_TOP = """top AS (SELECT query_id, id, round(d, 4) AS distance, r FROM (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r
    FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE r <= 3)"""
_VOTES = """votes AS (SELECT query_id, count(*) AS n, sum(CAST(label < 5 AS INT)) AS losses FROM top JOIN embeddings ON vec_id = id
    WHERE distance <= 0.9::DOUBLE GROUP BY 1)"""


def _hits(t):
    return sm.cosine_top_k(t.embeddings, t.embeddings, 3, "vec_id", skip_same=True)


def _outcomes(t):
    return t.embeddings.select(F.col("vec_id").alias("record_id"), (F.col("label") < 5).alias("is_loss_making"))


@query(
    "pl4_conflict",
    f"""WITH {_TOP}, {_VOTES} SELECT vec_id, coalesce((losses > n / 2.0::DOUBLE) <> (label % 2 = 0), FALSE) AS conflict
        FROM embeddings LEFT JOIN votes ON query_id = vec_id""",
)
def _(t):
    votes = pl.neighbour_votes(_hits(t), _outcomes(t), 0.9).withColumnRenamed("query_id", "vec_id")
    joined = t.embeddings.select("vec_id", (F.col("label") % 2 == 0).alias("pred")).join(votes, "vec_id", "left")
    return joined.select("vec_id", pl.conflict_detected(F.col("pred"), F.col("majority_loss")).alias("conflict"))


@query("pl5_escalation", f"WITH {_BASE} SELECT record_key, confidence = 'low' OR record_key % 9 = 0 AS escalate FROM gated")
def _(t):
    return _decided(t).select(
        "record_key", pl.should_escalate(F.col("confidence_level"), F.col("record_key") % 9 == 0).alias("escalate")
    )


_ASSESSED = f"""{_BASE}, {_TOP}, {_VOTES},
    linked AS (SELECT g.*, retrieve AND record_key % 7 = 3 AS broken, retrieve AND record_key % 7 <> 3 AS searched, record_key % (SELECT count(*) FROM embeddings) AS vec FROM gated g),
    joined AS (SELECT l.*, searched AND EXISTS (SELECT 1 FROM top WHERE query_id = vec) AS has_hits,
        searched AND coalesce((losses > n / 2.0::DOUBLE) <> pred, FALSE) AS conflict FROM linked l LEFT JOIN votes ON query_id = vec),
    assessed AS (SELECT *, conflict OR confidence = 'low' AS escalate,
        list_concat(CASE WHEN failed THEN [concat('Prediction failed: ', CASE WHEN error = '' THEN 'unknown error' ELSE error END)] ELSE []::VARCHAR[] END, flags,
            CASE WHEN broken THEN ['Retrieval failed: store offline'] ELSE []::VARCHAR[] END,
            CASE WHEN conflict THEN ['Model prediction conflicts with majority of similar historical records.'] ELSE []::VARCHAR[] END) AS warnings FROM joined)"""


def _assessed(t):
    """Every record takes the search results of one embedding; some searches are marked as failed."""
    scored = _scored(t).withColumn("retrieval_error", F.when(F.col("record_key") % 7 == 3, F.lit("store offline")))
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    decided = written(pl.with_decision(pl.with_prediction_stub(scored)))
    wanted = decided.where("retrieve AND retrieval_error IS NULL").select("record_id", (F.col("record_key") % n).alias("vec"))
    searched = t.embeddings.join(wanted.select(F.col("vec").alias("vec_id")).distinct(), "vec_id", "left_semi")
    found = written(sm.cosine_top_k(searched, t.embeddings, 3, "vec_id", skip_same=True)).withColumnRenamed("query_id", "vec")
    hits = wanted.join(found, "vec").select(F.col("record_id").alias("query_id"), "id", "distance", "rank")
    return pl.assess(decided, hits, _outcomes(t), "record_id", ["record_id", "risk_type", "territory"], max_distance=0.9)


@query(
    "pl6_assessment",
    f"""WITH {_ASSESSED} SELECT concat('REC_', record_key) AS record_id, CASE WHEN confidence = 'low' THEN 'unclear' WHEN pred THEN 'likely_loss' ELSE 'unlikely_loss' END AS risk_assessment,
        confidence AS confidence_level, escalate AS second_opinion_recommended, conflict AS conflict_detected, array_to_string(warnings, '|') AS warnings,
        CASE WHEN searched THEN 'predict_loss|retrieve_similar_records' ELSE 'predict_loss' END AS tools_used,
        NOT (escalate AND confidence = 'low' AND NOT has_hits) AS has_evidence FROM assessed""",
)
def _(t):
    return _assessed(t).select(
        "record_id", "risk_assessment", "confidence_level", "second_opinion_recommended", "conflict_detected",
        F.array_join("warnings", "|").alias("warnings"), F.array_join("tools_used", "|").alias("tools_used"),
        F.col("evidence").isNotNull().alias("has_evidence"),
    )


_RISK = "round(least(1, greatest(0, 0.5D + 0.05D * (coalesce(prior_claims, 0) - 5) - 0.004D * (coalesce(years_trading, 0) - 25))), 4)"


@query(
    "pl6_assess_requests",
    f"""WITH {RECORDS}, {STORED}, base AS (SELECT record_id, {FLAGS_SQL} AS flags, {_RISK.replace("D ", "::DOUBLE ")} AS p, {RETRIEVAL_SQL} AS q FROM records),
        conf AS (SELECT *, p >= 0.5 AS pred, abs(p - 0.5) AS m, len(list_filter(flags, lambda f: f LIKE 'optional%')) > 0 AS opt,
            len(list_filter(flags, lambda f: f LIKE 'required%' OR f LIKE 'invalid%')) > 0 AS forced FROM base),
        decided AS (SELECT *, CASE WHEN forced THEN 'low' WHEN m >= 0.3::DOUBLE THEN CASE WHEN opt THEN 'medium' ELSE 'high' END
            WHEN m >= 0.15::DOUBLE THEN CASE WHEN opt THEN 'low' ELSE 'medium' END ELSE 'low' END AS confidence FROM conf),
        top AS (SELECT q, doc_id, d, r FROM (SELECT q, doc_id, d, row_number() OVER (PARTITION BY q ORDER BY d, place) AS r FROM (
            SELECT q, doc_id, place, round(1 - list_cosine_similarity({letters_sql('q')}, v), 9) AS d FROM (SELECT DISTINCT q FROM decided WHERE confidence = 'low'), stored)) WHERE r <= 3),
        near AS (SELECT q, string_agg(doc_id, '|' ORDER BY r) AS found, count(*) FILTER (round(d, 4) <= 0.5::DOUBLE) AS n,
            count(*) FILTER (round(d, 4) <= 0.5::DOUBLE AND doc_id % 3 = 0) AS losses FROM top GROUP BY q),
        joined AS (SELECT d.*, found, confidence = 'low' AS searched, confidence = 'low' AND coalesce(n > 0 AND (losses > n / 2.0::DOUBLE) <> pred, FALSE) AS conflict
            FROM decided d LEFT JOIN near ON near.q = d.q AND confidence = 'low')
        SELECT record_id, CASE WHEN confidence = 'low' THEN 'unclear' WHEN pred THEN 'likely_loss' ELSE 'unlikely_loss' END AS risk_assessment, confidence AS confidence_level,
            conflict OR confidence = 'low' AS second_opinion_recommended, conflict AS conflict_detected, found,
            array_to_string(list_concat(flags, CASE WHEN conflict THEN ['{pl.CONFLICT_WARNING}'] ELSE []::VARCHAR[] END), '|') AS warnings,
            CASE WHEN searched THEN 'predict_loss|retrieve_similar_records' ELSE 'predict_loss' END AS tools_used FROM joined""",
)
def _(t):
    """JSON requests, a fixed linear score, a text search on a document store."""
    names = [f.name for f in REQUEST.fields]
    payload = records(t).select(F.to_json(F.struct(*names)).alias("payload"))
    requests = payload.select(record_struct("payload").alias("r")).select("r.*")

    def predict(df):
        p = F.expr(_RISK)
        return df.withColumns(
            {
                "probability_of_loss": p, "is_loss_making_prediction": p >= 0.5,
                "top_features": F.array(F.lit("prior_claims"), F.lit("years_trading")), "model_warnings": F.array().cast("array<string>"),
            }
        )

    store, embed = letter_store(t)
    outcomes = t.documents.select(F.col("doc_id").cast("string").alias("record_id"), (F.col("doc_id") % 3 == 0).alias("is_loss_making"))
    out = assess_requests(requests, predict, lambda texts: store.search(texts, embed, shared=True), outcomes, record_fields=names)
    shown = F.from_json("evidence", "struct<retrieved_records:array<struct<record_id:string>>>")["retrieved_records"]
    return out.select(
        "record_id", "risk_assessment", "confidence_level", "second_opinion_recommended", "conflict_detected",
        F.array_join(shown["record_id"], "|").alias("found"), F.array_join("warnings", "|").alias("warnings"), F.array_join("tools_used", "|").alias("tools_used"),
    )


@query(
    "pl7_fixed_response",
    f"""WITH {_ASSESSED} SELECT concat('REC_', record_key) AS record_id, '{pl.RECOMMENDATION}' AS recommendation,
        concat('Model confidence is low. ', CASE WHEN len(warnings) > 0 THEN concat('Issues: ', array_to_string(warnings[:3], '; '), '.') ELSE '' END) AS summary
        FROM assessed WHERE escalate AND confidence = 'low' AND NOT has_hits""",
)
def _(t):
    return _assessed(t).where("recommendation IS NOT NULL").select("record_id", "recommendation", "summary")


_JUDGED = f"""{RECORDS}, j AS (SELECT record_key, is_loss_making, CASE WHEN record_key % 4 = 0 THEN 'borderline' WHEN record_key % 4 = 1 THEN 'clear_loss' END AS case_type,
    CASE WHEN record_key % 10 < 8 THEN record_key % 10 < 6 END AS aligned, CASE WHEN record_key % 13 <> 0 THEN record_key % 3 <> 0 END AS calibrated,
    (record_key % 97) / 10.0::DOUBLE AS latency_s FROM records)"""


def _judged(t):
    k = F.col("record_key")
    return records(t).select(
        "record_key", "is_loss_making",
        F.when(k % 4 == 0, F.lit("borderline")).when(k % 4 == 1, F.lit("clear_loss")).alias("case_type"),
        F.when(k % 10 < 8, k % 10 < 6).alias("aligned"), F.when(k % 13 != 0, k % 3 != 0).alias("calibrated"),
        ((k % 97) / F.lit(10.0)).alias("latency_s"),
    )


@query("pl8_verdict", f"WITH {_JUDGED} SELECT record_key, coalesce(aligned AND calibrated, FALSE) AS correct FROM j")
def _(t):
    return _judged(t).select("record_key", pl.verdict(F.col("aligned"), F.col("calibrated")).alias("correct"))


@query(
    "pl9_evaluation_summary",
    f"WITH {_JUDGED}, v AS (SELECT *, coalesce(aligned AND calibrated, FALSE) AS correct FROM j) "
    + " UNION ALL ".join(
        f"""SELECT '{s}' AS slice, {v} AS value, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (correct) AS BIGINT) AS correct,
        round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(avg(latency_s), 6) AS avg_latency_s FROM v GROUP BY 2"""
        for s, v in (("overall", "'all'"), ("label", "CAST(is_loss_making AS VARCHAR)"), ("case_type", "case_type"))
    ),
)
def _(t):
    df = _judged(t).withColumn("correct", pl.verdict(F.col("aligned"), F.col("calibrated")))
    out = pl.evaluation_summary(df)
    return out.select("slice", "value", "rows", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("avg_latency_s", 6).alias("avg_latency_s"))


_MODEL = """CASE event_type WHEN 'click' THEN 'gpt-5' WHEN 'view' THEN 'gpt-5-mini-2025' WHEN 'purchase' THEN 'gpt-4.1' WHEN 'signup' THEN 'gpt-5.2-x' ELSE 'other' END"""


def _responses(t):
    """Response JSON from events: two spellings of token names and three places for tool calls."""
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id") % 4
    spelled = F.when(
        n < 2, F.concat(F.lit('"usage":{"input_tokens":'), k, F.lit(',"output_tokens":'), F.col("event_id") % 50, F.lit("}"))
    ).when(n == 2, F.concat(F.lit('"usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":7,"total_tokens":500}'))).otherwise('"id":"x"')
    calls = (
        F.when(n == 0, F.lit(',"tool_calls":[{"name":"lookup"},{"type":"web_search_call"}]'))
        .when(n == 1, F.lit(',"output":[{"type":"web_search_call"},{"type":"message","content":[{"type":"file_search_call"},{"type":"text"}]},{"type":"web_search_call"}]'))
        .otherwise("")
    )
    return t.events.select(
        "event_id", F.expr(_MODEL).alias("model"), F.concat(F.lit("{"), spelled, calls, F.lit("}")).alias("body"),
        (F.when(F.col("event_id") % 6 == 5, 500).otherwise(200)).alias("status_code"),
    )


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_TOKENS = f"""u AS (SELECT event_id, {_MODEL} AS model, event_id % 4 AS n, CASE WHEN event_id % 4 < 3 THEN {_K} END AS i,
    CASE WHEN event_id % 4 < 2 THEN event_id % 50 WHEN event_id % 4 = 2 THEN 7 END AS o FROM events)"""


@query(
    "co1_token_usage",
    f"""WITH {_TOKENS} SELECT event_id, i AS input_tokens, CAST(o AS BIGINT) AS output_tokens,
        CAST(CASE WHEN n = 2 THEN 500 ELSE i + o END AS BIGINT) AS total_tokens FROM u""",
)
def _(t):
    out = us.with_usage(_responses(t), "body")
    return out.select("event_id", "input_tokens", "output_tokens", "total_tokens")


@query(
    "co2_tool_calls",
    """SELECT 'lookup' AS tool, count(*) AS calls FROM events WHERE event_id % 4 = 0
        UNION ALL SELECT 'web_search', count(*) FILTER (event_id % 4 = 0) + 2 * count(*) FILTER (event_id % 4 = 1) FROM events
        UNION ALL SELECT 'file_search', count(*) FROM events WHERE event_id % 4 = 1""".replace("count(*) AS calls", "CAST(count(*) AS BIGINT) AS calls"),
)
def _(t):
    return us.tool_call_counts(_responses(t), "body")


def _price_sql(compat: bool) -> str:
    mini = "(1.25, 10.0)" if compat else "(0.25, 2.0)"
    two = "(1.25, 10.0)" if compat else "(1.75, 14.0)"
    return f"""WITH {_TOKENS}, p(m, a, b) AS (VALUES ('gpt-5', 1.25::DOUBLE, 10.0::DOUBLE), ('gpt-5-mini-2025', {mini[1:-1].replace(', ', '::DOUBLE, ')}::DOUBLE),
            ('gpt-4.1', 2.0, 8.0), ('gpt-5.2-x', {two[1:-1].replace(', ', '::DOUBLE, ')}::DOUBLE)),
        c AS (SELECT event_id, round(i / 1000000 * a + o / 1000000 * b, 9) AS tokens, CASE n WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 0.0225 ELSE 0.0 END AS tools FROM u LEFT JOIN p ON m = model)
        SELECT event_id, tokens AS token_cost_usd, tools AS tool_cost_usd, round(coalesce(tokens, 0) + tools, 9) AS cost_usd FROM c"""


@query("co3_cost", _price_sql(False))
def _(t):
    out = us.with_usage(_responses(t), "body", digits=9)
    return out.select("event_id", "token_cost_usd", "tool_cost_usd", F.round("cost_usd", 9).alias("cost_usd"))


@query("co3_cost_first_prefix", _price_sql(True))
def _(t):
    out = us.with_usage(_responses(t), "body", compat=True, digits=9)
    return out.select("event_id", "token_cost_usd", "tool_cost_usd", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "co4_batch_cost",
    f"""WITH {_TOKENS}, s AS (SELECT sum(i) AS i, sum(o) AS o, count(*) FILTER (n = 0) * 2 + count(*) FILTER (n = 1) * 3 AS calls,
            count(*) FILTER (n = 0) + 2 * count(*) FILTER (n = 1) AS web, count(*) FILTER (n = 1) AS file FROM u WHERE event_id % 6 <> 5),
        c AS (SELECT *, round(round(i / 1000000 * 1.25::DOUBLE + o / 1000000 * 10.0::DOUBLE, 6) * 0.5::DOUBLE, 6) AS tokens, round(web * 0.01::DOUBLE + file * 0.0025::DOUBLE, 6) AS tools FROM s)
        SELECT 'gpt-5' AS model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(i + o AS BIGINT) AS total_tokens, tokens AS token_cost_usd,
            CAST(calls AS BIGINT) AS tool_calls, tools AS tool_cost_usd, round(tokens + tools, 6) AS cost_usd FROM c""",
)
def _(t):
    nested = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"response":'), F.col("body"), F.lit("}"))).otherwise(F.col("body"))
    out = us.batch_cost(_responses(t).withColumn("body", nested), "gpt-5", discount=0.5)
    return out.withColumn("cost_usd", F.round("cost_usd", 6))

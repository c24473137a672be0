"""Classifiers, scoring, evaluation tables and cluster counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.records import records
from riskloom.catalog.registry import query
from riskloom.operators import clusters as km
from riskloom.operators import evaluation as ev
from riskloom.operators import models as md
from riskloom.operators.features import feature_steps
from riskloom.operators.splits import stratified_split
from riskloom.plans.frames import written

_KEY, _TARGET = "record_key", "is_loss_making"


def _prepared(t):
    """Feature frames of train and test records."""
    df = written(records(t).drop("record_id"))
    train, test = stratified_split(df, _TARGET, _KEY, 0.2)
    fitted, x = feature_steps(key=_KEY).fit_transform(train)
    return x, written(fitted.transform(test)), [c for c in x.columns if c not in (_KEY, _TARGET)]


def _logistic(t):
    x, y, features = _prepared(t)
    pool = {"logistic_regression": md.candidate_models(_TARGET, "__weight")["logistic_regression"]}
    return md.train_candidates(x, features, _TARGET, _KEY, candidates=pool), x, y


@query("md1_train_candidates")
def _(t):
    x, y, features = _prepared(t)
    pool = md.candidate_models(_TARGET, "__weight", trees=200)
    trained = md.train_candidates(x, features, _TARGET, _KEY, test=y, candidates=pool)
    rows = [(s["model"], s["val_auc"], s["test_auc"], s["model"] == trained.model_name) for s in trained.scores]
    return t.spark.createDataFrame(rows, "model string, val_auc double, test_auc double, chosen boolean")


@query("md2_batch_scoring")
def _(t):
    trained, _x, y = _logistic(t)
    return md.score(y, trained).select(_KEY, "probability_of_loss", "is_loss_making_prediction")


_GIVEN = {"l_quantity": 0.04, "l_discount": -12.0, "l_tax": 5.0}


@query(
    "md2_given_model",
    """WITH p AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-(0.04::DOUBLE * l_quantity - 12.0::DOUBLE * l_discount + 5.0::DOUBLE * l_tax - 0.7::DOUBLE))) AS p FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(p, 4) AS probability_of_loss, p >= 0.5 AS is_loss_making_prediction FROM p""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *_GIVEN)
    out = md.score(rows, md.given_model(_GIVEN, -0.7, _TARGET))
    return out.select("l_orderkey", "l_linenumber", "probability_of_loss", "is_loss_making_prediction")


@query(
    "md4_given_model",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS importance FROM lineitem" for c in _GIVEN),
)
def _(t):
    means = t.lineitem.agg(*[F.avg(c).alias(c) for c in _GIVEN]).first().asDict()
    ranked = md.top_features(md.given_model(means, 0.0, _TARGET), 3)
    return t.spark.createDataFrame(ranked, "feature string, importance double").select("feature", F.round("importance", 6).alias("importance"))


_SCORE = "((o_orderkey * 7919) % 1009) / 1008.0::DOUBLE"
_LABEL = "(((o_orderkey * 7919) % 1009) + o_orderkey % 500 > 750)"
_SCORED = f"s AS (SELECT o_orderkey, {_SCORE} AS score, CAST({_LABEL} AS INT) AS y FROM orders)"


def _scored(t):
    hashed = F.expr("(o_orderkey * 7919) % 1009")
    return t.orders.select(
        "o_orderkey", (hashed / F.lit(1008.0)).alias("score"), (hashed + F.expr("o_orderkey % 500") > 750).cast("int").alias("y")
    )


@query("md3_serving", f"WITH {_SCORED} SELECT o_orderkey, round(score, 8) AS pred_prob, score > 0.75 AS pred FROM s")
def _(t):
    out = md.serve(_scored(t), "score", 0.75)
    return out.select("o_orderkey", F.round("pred_prob", 8).alias("pred_prob"), "pred")


@query("md4_top_features")
def _(t):
    trained, _x, _y = _logistic(t)
    return t.spark.createDataFrame(md.top_features(trained, 5), "feature string, importance double")


_WEIGHTS = {"l_quantity": 0.4, "l_discount": -3.0, "l_tax": 1.5}


@query(
    "md5_linear_contributions",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - (SELECT avg({c}) FROM lineitem)))), 8) AS importance FROM lineitem"
        for c, w in _WEIGHTS.items()
    ),
)
def _(t):
    out = md.linear_contributions(t.lineitem, _WEIGHTS)
    return out.select("feature", F.round("importance", 8).alias("importance"))


@query("md5_permutation_importance")
def _(t):
    trained, _x, y = _logistic(t)
    return md.permutation_importance(y, trained, _KEY)


_AUC_SQL = """(SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM (
    SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1)))"""


@query("ev1_roc_auc", f"WITH {_SCORED} SELECT round(auc, 9) AS auc FROM {_AUC_SQL}")
def _(t):
    return ev.roc_auc(_scored(t), "y", "score").select(F.round("auc", 9).alias("auc"))


_T = ", ".join(f"({x}::DOUBLE)" for x in ev.THRESHOLDS)
_COUNTS = f"""{_SCORED}, th(t) AS (VALUES {_T}),
    c AS (SELECT t, count(*) FILTER (y = 1 AND score > t)::DOUBLE AS tp, count(*) FILTER (y = 0 AND score > t)::DOUBLE AS fp,
        count(*) FILTER (y = 1 AND score <= t)::DOUBLE AS fn, count(*) FILTER (y = 0 AND score <= t)::DOUBLE AS tn FROM s, th GROUP BY t)"""


@query(
    "ev2_threshold_sweep",
    f"""WITH {_COUNTS}, m AS (SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS sp,
            CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f,
            sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn) AS d, tp + fp + fn + tn AS n FROM c)
        SELECT t AS classification_threshold, (SELECT round(auc * 100, 4) FROM {_AUC_SQL}) AS auc, round((tp + tn) / n * 100, 4) AS accuracy,
            round((r + sp) / 2 * 100, 4) AS balanced_accuracy, round(r * 100, 4) AS recall, round(p * 100, 4) AS precision, round(f * 100, 4) AS f1_score,
            round(CASE WHEN d = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / d END * 100, 4) AS mcc,
            round((fp + fn) / n * 36.04365338911715 * 100, 4) AS log_loss FROM m""",
)
def _(t):
    return ev.threshold_sweep(_scored(t), "y", "score", digits=4)


@query(
    "ev3_confusion_table",
    f"""WITH {_COUNTS} SELECT t AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
            {', '.join(f'round({c} / (tp + fp + tn + fn) * 100, 4) AS {c}_pct' for c in ('tp', 'fp', 'tn', 'fn'))},
            round((tp + tn) / (tp + fp + tn + fn) * 100, 4) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 4) AS recall,
            round(coalesce(tp / nullif(tp + fp, 0), 0) * 100, 4) AS precision, CAST(tp + fp AS BIGINT) AS predicted_positives,
            round((tp + fp) / (tp + fp + tn + fn) * 100, 4) AS traffic_blocked_pct FROM c""",
)
def _(t):
    return ev.confusion_table(_scored(t), "y", "score", digits=4)


_ROC = f"""{_SCORED}, g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1),
    roc AS (SELECT score AS threshold, sum(neg) OVER w / (SELECT sum(neg) FROM g)::DOUBLE AS fpr,
        sum(pos) OVER w / (SELECT sum(pos) FROM g)::DOUBLE AS tpr, sum(pos + neg) OVER w / (SELECT count(*) FROM s)::DOUBLE AS flagged
        FROM g WINDOW w AS (ORDER BY score DESC))"""


@query("ev4_roc_points", f"WITH {_ROC} SELECT round(threshold, 8) AS threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM roc")
def _(t):
    out = ev.roc_points(_scored(t), "y", "score")
    return out.select(*[F.round(c, 8).alias(c) for c in ("threshold", "fpr", "tpr")])


@query(
    "ev5_threshold_for_risk",
    f"""WITH {_ROC} SELECT 'recall' AS mode, round(max(threshold), 8) AS threshold FROM roc
            WHERE tpr >= round_even((SELECT count(*) FROM s) * 0.02::DOUBLE, 0) / (SELECT count(*) FROM s)
        UNION ALL SELECT 'flagged', round(min(threshold), 8) FROM roc WHERE flagged <= 0.02""",
)
def _(t):
    df = _scored(t)
    both = [
        ev.threshold_for_risk(df, "y", "score", 0.02, m).select(F.lit(m).alias("mode"), F.round("threshold", 8).alias("threshold"))
        for m in ("recall", "flagged")
    ]
    return both[0].unionByName(both[1])


@query(
    "ev6_classification_report",
    f"""WITH {_SCORED}, p AS (SELECT y, CAST(score > 0.6 AS INT) AS p FROM s),
        k AS (SELECT c, count(*) FILTER (y = c)::DOUBLE AS sup, count(*) FILTER (p = c)::DOUBLE AS cal, count(*) FILTER (y = c AND p = c)::DOUBLE AS hit
            FROM p, (VALUES (0), (1)) AS v(c) GROUP BY c),
        m AS (SELECT c, sup, hit, hit / cal AS pr, hit / sup AS re, 2 * hit / (cal + sup) AS f FROM k)
        SELECT CAST(c AS VARCHAR) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, CAST(sup AS BIGINT) AS support FROM m
        UNION ALL SELECT 'accuracy', round(sum(hit) / sum(sup), 6), round(sum(hit) / sum(sup), 6), round(sum(hit) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM m
        UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(sup) AS BIGINT) FROM m
        UNION ALL SELECT 'weighted avg', round(sum(pr * sup) / sum(sup), 6), round(sum(re * sup) / sum(sup), 6), round(sum(f * sup) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM m""",
)
def _(t):
    df = _scored(t).withColumn("p", (F.col("score") > 0.6).cast("int"))
    return ev.classification_report(df, "y", "p", 6)


def _vectors(t):
    return km.as_vectors(t.embeddings, "embedding")


@query("km1_optimal_clusters_davies_bouldin")
def _(t):
    return km.cluster_scores(_vectors(t), "features", 2, 10, "davies_bouldin")


@query(
    "km1_davies_bouldin_of_labels",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
        c AS (SELECT label, d, avg(v) AS m FROM x GROUP BY 1, 2),
        s AS (SELECT label, avg(dist) AS s FROM (SELECT x.vec_id, x.label, sqrt(sum((v - m) * (v - m))) AS dist FROM x JOIN c USING (label, d) GROUP BY 1, 2) GROUP BY 1),
        e AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2),
        r AS (SELECT i, max((a.s + b.s) / dist) AS worst FROM e JOIN s a ON a.label = i JOIN s b ON b.label = j GROUP BY 1)
        SELECT round(avg(worst), 6) AS davies_bouldin FROM r""",
)
def _(t):
    value = km.davies_bouldin(_vectors(t), "features", "label")
    return t.spark.createDataFrame([(round(value, 6),)], "davies_bouldin double")


@query("km2_optimal_clusters_silhouette")
def _(t):
    return km.cluster_scores(_vectors(t), "features", 2, 10, "silhouette")


@query(
    "km2_silhouette_of_labels",
    """WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) AS total, count(*) AS n
            FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
        o AS (SELECT vec_id, total / nullif(n - 1, 0) AS a FROM p WHERE own = other),
        q AS (SELECT vec_id, min(total / n) AS b FROM p WHERE own <> other GROUP BY 1)
        SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM o JOIN q USING (vec_id)""",
)
def _(t):
    value = km.silhouette(_vectors(t).select("features", "label"), "features", "label")
    return t.spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query(
    "km2_euclidean_silhouette_of_labels",
    """WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS total, count(*) AS n
            FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
        o AS (SELECT vec_id, total / nullif(n - 1, 0) AS a FROM p WHERE own = other),
        q AS (SELECT vec_id, min(total / n) AS b FROM p WHERE own <> other GROUP BY 1)
        SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM o JOIN q USING (vec_id)""",
)
def _(t):
    value = km.euclidean_silhouette(_vectors(t).select("features", "label"), "features", "label")
    return t.spark.createDataFrame([(round(value, 6),)], "silhouette double")


_CUTS = (2, 3, 5)


def _choice(t, metric):
    """Scores of label columns with 2, 3 and 5 values, and the count they choose."""
    df, score = _vectors(t), km.davies_bouldin if metric == "davies_bouldin" else km.silhouette
    scores = [(k, score(df.select("features", F.pmod("vec_id", F.lit(k)).alias("cut")), "features", "cut")) for k in _CUTS]
    rows = [(k, round(v, 6), best) for k, v, best in km.best_score(scores, metric)]
    return t.spark.createDataFrame(rows, "clusters int, score double, best boolean")


_CUT_ROWS = f"cut AS (SELECT k, vec_id, vec_id % k AS label, embedding FROM embeddings, (VALUES {', '.join(f'({k})' for k in _CUTS)}) AS v(k))"


@query(
    "km1_choice_of_labels",
    f"""WITH {_CUT_ROWS}, x AS (SELECT k, vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM cut),
        c AS (SELECT k, label, d, avg(v) AS m FROM x GROUP BY 1, 2, 3),
        s AS (SELECT k, label, avg(dist) AS s FROM (SELECT k, vec_id, label, sqrt(sum((v - m) * (v - m))) AS dist FROM x JOIN c USING (k, label, d) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        e AS (SELECT a.k, a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.k = b.k AND a.d = b.d AND a.label <> b.label GROUP BY 1, 2, 3),
        r AS (SELECT e.k, i, max((a.s + b.s) / dist) AS worst FROM e JOIN s a ON a.k = e.k AND a.label = i JOIN s b ON b.k = e.k AND b.label = j GROUP BY 1, 2),
        f AS (SELECT CAST(k AS INT) AS clusters, avg(worst) AS score FROM r GROUP BY 1)
        SELECT clusters, round(score, 6) AS score, score = min(score) OVER () AS best FROM f""",
)
def _(t):
    return _choice(t, "davies_bouldin")


@query(
    "km2_choice_of_labels",
    f"""WITH {_CUT_ROWS}, pairs AS (SELECT a.vec_id AS p, b.vec_id AS q, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2 AS d FROM embeddings a, embeddings b),
        t AS (SELECT k, p, p % k AS own, q % k AS other, sum(d) AS total, count(*) AS n FROM pairs, (SELECT DISTINCT k FROM cut) GROUP BY 1, 2, 3, 4),
        o AS (SELECT k, p, total / nullif(n - 1, 0) AS a FROM t WHERE own = other),
        b AS (SELECT k, p, min(total / n) AS b FROM t WHERE own <> other GROUP BY 1, 2),
        f AS (SELECT CAST(k AS INT) AS clusters, avg((b - a) / greatest(a, b)) AS score FROM o JOIN b USING (k, p) GROUP BY 1)
        SELECT clusters, round(score, 6) AS score, score = max(score) OVER () AS best FROM f""",
)
def _(t):
    return _choice(t, "silhouette")

"""Queries on predictions: validation, gate, metrics, calibration, referral."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import metrics as M
from ..operators import referral as R
from .adapters import K, PREDS, SCREENED, predictions, screened
from .registry import query

TH = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)
BINARY = (0.3, 0.4, 0.5, 0.6, 0.7)
DECISION = tuple(round(0.05 * i, 2) for i in range(1, 19))


def r(c: str, n: int = 9):
    return F.round(F.col(c), n).alias(c)


def doubles(values: tuple[float, ...]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def gated(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with what the gate needs, computed once."""
    p = predictions(spark, d)
    p = p.withColumns({"pred": P.argmax("pa"), "conf": P.top("pa"), "ent": P.entropy("pa", K), "pred_b": P.argmax("pb")})
    return p.withColumns({"ok": F.col("pred") == F.col("y"), "single": P.retained_single("pa", K), "full_gate": P.retained("pa", "pb", K)})


def points(spark: SparkSession, d: str) -> DataFrame:
    return M.scored(predictions(spark, d).withColumnRenamed("pa", "p"), K)


BROKEN = """CASE id % 11 WHEN 0 THEN pa[1:3] WHEN 1 THEN list_transform(pa, lambda v: v * 2) WHEN 2 THEN list_transform(pa, lambda v: v * 0.5::DOUBLE)
    WHEN 3 THEN list_transform(pa, lambda v: -v) WHEN 4 THEN [NULL, 0.5::DOUBLE, 0.5::DOUBLE, 0::DOUBLE] WHEN 5 THEN ['nan'::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE] ELSE pa END"""


@query("val_prob", f"""WITH {PREDS}, b AS (SELECT id, {BROKEN} AS p FROM preds),
n AS (SELECT id, p, len(p) AS n, len(list_filter(p, lambda v: v IS NULL)) AS nulls, len(list_filter(p, lambda v: isnan(v) OR isinf(v))) AS odd, len(list_filter(p, lambda v: v < 0 OR v > 1)) AS outside, list_sum(p) AS s FROM b)
SELECT id, CASE WHEN n <> 4 THEN 'length' WHEN nulls > 0 THEN 'not_numeric' WHEN odd > 0 THEN 'not_finite' WHEN outside > 0 THEN 'out_of_range' WHEN abs(s - 1) > 1e-6 THEN 'sum' END AS reason FROM n""")
def val_prob(spark: SparkSession, d: str) -> DataFrame:
    pa, i = F.col("pa"), F.col("id") % 11
    p = F.when(i == 0, F.slice(pa, 1, 3)).when(i == 1, F.transform(pa, lambda v: v * 2)).when(i == 2, F.transform(pa, lambda v: v * 0.5)).when(i == 3, F.transform(pa, lambda v: -v))
    p = p.when(i == 4, F.array(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5), F.lit(0.0))).when(i == 5, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(pa)
    return predictions(spark, d).select("id", P.invalid_reason(p, K).alias("reason"))


@query("argmax", f"WITH {PREDS} SELECT id, pred_a, pred_b FROM preds")
def argmax(spark, d):
    return predictions(spark, d).select("id", P.argmax("pa").alias("pred_a"), P.argmax("pb").alias("pred_b"))


@query("maxprob", f"WITH {PREDS} SELECT id, conf_a FROM preds")
def maxprob(spark, d):
    return predictions(spark, d).select("id", P.top("pa").alias("conf_a"))


@query("margin", f"WITH {PREDS} SELECT id, list_sort(pa, 'DESC')[1] - list_sort(pa, 'DESC')[2] AS margin FROM preds")
def margin(spark, d):
    return predictions(spark, d).select("id", P.margin("pa").alias("margin"))


@query("entropy", f"WITH {PREDS} SELECT id, round(ent_a, 9) AS entropy FROM preds")
def entropy(spark, d):
    return predictions(spark, d).select("id", F.round(P.entropy("pa", K), 9).alias("entropy"))


@query("gate", f"""WITH {PREDS} SELECT id, pred_a AS roi_prediction, pred_b AS latent_prediction, single AS roi_only_retained,
CASE WHEN full_gate THEN 'retain_for_research' ELSE 'refer_for_human_review' END AS action,
concat_ws(' | ', CASE WHEN conf_a < 0.7::DOUBLE THEN 'roi_low_confidence' END, CASE WHEN ent_a > 0.65::DOUBLE THEN 'roi_high_entropy' END, CASE WHEN pred_a <> pred_b THEN 'branch_disagreement' END,
CASE WHEN conf_b < 0.5::DOUBLE THEN 'latent_low_confidence' END, CASE WHEN ent_b > 0.75::DOUBLE THEN 'latent_high_entropy' END) AS reasons FROM gated""")
def gate(spark, d):
    x = predictions(spark, d).select("id", P.decide("pa", "pb", K).alias("g"))
    return x.select("id", "g.roi_prediction", "g.latent_prediction", "g.roi_only_retained", "g.action", F.array_join("g.reasons", " | ").alias("reasons"))


@query("gate_vec", f"WITH {PREDS} SELECT id, full_gate AS retained FROM gated")
def gate_vec(spark, d):
    return predictions(spark, d).select("id", P.retained("pa", "pb", K).alias("retained"))


@query("gate_roi", f"WITH {PREDS} SELECT id, single AS retained FROM gated")
def gate_roi(spark, d):
    return predictions(spark, d).select("id", P.retained_single("pa", K).alias("retained"))


@query("gate_demo", f"WITH {PREDS} SELECT id, conf_a < 0.60::DOUBLE OR ent_a > 0.72::DOUBLE AS defer FROM preds")
def gate_demo(spark, d):
    return predictions(spark, d).select("id", (~P.retained_single("pa", K, P.GatePolicy(roi_confidence=0.60, roi_entropy=0.72))).alias("defer"))


@query("gate_agree", f"WITH {PREDS} SELECT pred_a = pred_b AS retained, count(*) AS n, count_if(ok) AS hits FROM gated GROUP BY 1")
def gate_agree(spark, d):
    return gated(spark, d).groupBy((F.col("pred") == F.col("pred_b")).alias("retained")).agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"))


@query("binarise", f"WITH {PREDS} SELECT id, CAST(y <> 3 AS INTEGER) AS abnormal, CAST(y = 0 AS INTEGER) AS c0, CAST(y = 1 AS INTEGER) AS c1, CAST(y = 2 AS INTEGER) AS c2, CAST(y = 3 AS INTEGER) AS c3 FROM preds")
def binarise(spark, d):
    h = P.onehot("y", K)
    return predictions(spark, d).select("id", (F.col("y") != 3).cast("int").alias("abnormal"), *[h[i].alias(f"c{i}") for i in range(K)])


@query("temp_scale", f"""WITH {PREDS}, z AS (SELECT id, list_transform(pa, lambda v: ln(greatest(v, 1e-9::DOUBLE)) / 1.5::DOUBLE) AS z FROM preds), e AS (SELECT id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z)
SELECT id, round(e[1] / list_sum(e), 9) AS q0, round(e[2] / list_sum(e), 9) AS q1, round(e[3] / list_sum(e), 9) AS q2, round(e[4] / list_sum(e), 9) AS q3 FROM e""")
def temp_scale(spark, d):
    q = predictions(spark, d).select("id", P.temperature("pa", 1.5).alias("q"))
    return q.select("id", *[F.round(F.col("q")[i], 9).alias(f"q{i}") for i in range(K)])


@query("mix", f"WITH {PREDS} SELECT id, " + ", ".join(f"round(pa[{i + 1}] * 0.35::DOUBLE + pb[{i + 1}] * 0.65::DOUBLE, 9) AS m{i}" for i in range(4)) + " FROM preds")
def mix(spark, d):
    m = predictions(spark, d).select("id", P.mixture([(0.35, "pa"), (0.65, "pb")]).alias("m"))
    return m.select("id", *[F.round(F.col("m")[i], 9).alias(f"m{i}") for i in range(K)])


CELLS = "cells AS (SELECT g.y, g.pred, count(p.id) AS n FROM (SELECT CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS pred FROM range(4) a, range(4) b) g LEFT JOIN preds p ON p.y = g.y AND p.pred_a = g.pred GROUP BY 1, 2)"
CLASSES = f"{CELLS}, cls AS (SELECT c.y, t.support, q.predicted, c.n AS hits, CASE WHEN q.predicted = 0 THEN 0 ELSE c.n::DOUBLE / q.predicted END AS precision, CASE WHEN t.support = 0 THEN 0 ELSE c.n::DOUBLE / t.support END AS recall FROM cells c JOIN (SELECT y, sum(n)::BIGINT AS support FROM cells GROUP BY y) t ON t.y = c.y JOIN (SELECT pred, sum(n)::BIGINT AS predicted FROM cells GROUP BY pred) q ON q.pred = c.y WHERE c.y = c.pred), cl AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM cls)"


def cells(spark, d) -> DataFrame:
    return M.confusion(predictions(spark, d).withColumn("pred", P.argmax("pa")), K)


@query("agg_count_by", f"WITH {PREDS} SELECT y, part, count(*) AS n FROM preds GROUP BY y, part")
def agg_count_by(spark, d):
    return predictions(spark, d).groupBy("y", "part").agg(F.count("*").alias("n"))


@query("agg_confusion", f"WITH {PREDS}, {CELLS} SELECT y, pred, n FROM cells")
def agg_confusion(spark, d):
    return cells(spark, d)


@query("agg_rownorm", f"WITH {PREDS}, {CELLS} SELECT y, pred, round(n * 100.0::DOUBLE / greatest(sum(n) OVER (PARTITION BY y), 1), 9) AS percent FROM cells")
def agg_rownorm(spark, d):
    return M.row_percent(cells(spark, d)).select("y", "pred", r("percent"))


@query("agg_report", f"""WITH {PREDS}, {CLASSES}, rep AS (SELECT CAST(y AS VARCHAR) AS label, precision, recall, f1, support FROM cl
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT sum(hits)::DOUBLE / sum(support) AS a, sum(support)::BIGINT AS n FROM cl)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM cl
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM cl)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rep""")
def agg_report(spark, d):
    return M.report(cells(spark, d)).select("label", r("precision"), r("recall"), r("f1"), "support")


SUMMARY = """s AS (SELECT sum(support)::DOUBLE AS n, sum(hits)::DOUBLE AS c, avg(recall) AS ba, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(support::DOUBLE * predicted) AS tp, sum(support::DOUBLE * support) AS tt, sum(predicted::DOUBLE * predicted) AS pp FROM cl)"""


@query("agg_metrics", f"""WITH {PREDS}, {CLASSES}, {SUMMARY} SELECT round(c / n, 9) AS accuracy, round(ba, 9) AS balanced_accuracy, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1,
round((c * n - tp) / (sqrt(n * n - pp) * sqrt(n * n - tt)), 9) AS mcc, (SELECT round(avg(-ln(least(greatest(pa[y + 1], 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))), 9) FROM preds) AS log_loss FROM s""")
def agg_metrics(spark, d):
    p = predictions(spark, d)
    m = M.summary(M.confusion(p.withColumn("pred", P.argmax("pa")), K)).crossJoin(M.log_loss(p, "y", "pa"))
    return m.select(*[r(c) for c in m.columns])


POINTS = "pts AS (SELECT CAST(c.range AS INTEGER) AS c, pa[c.range + 1] AS score, CAST(y = c.range AS INTEGER) AS hit FROM preds, range(4) c), run AS (SELECT c, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM pts GROUP BY 1, 2), cum AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_above, coalesce(sum(neg) OVER w, 0) AS neg_above FROM run WINDOW w AS (PARTITION BY c ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("agg_auc", f"WITH {PREDS}, {POINTS} SELECT c, round(sum(neg::DOUBLE * pos_above + neg::DOUBLE * pos / 2) / (sum(pos)::DOUBLE * sum(neg)), 9) AS auc FROM cum GROUP BY c")
def agg_auc(spark, d):
    return M.auc(points(spark, d)).select("c", r("auc"))


@query("agg_ap", f"WITH {PREDS}, {POINTS} SELECT c, round(sum(pos * (pos_above + pos)::DOUBLE / (pos_above + pos + neg_above + neg)) / sum(pos), 9) AS ap FROM cum GROUP BY c")
def agg_ap(spark, d):
    return M.average_precision(points(spark, d)).select("c", r("ap"))


@query("agg_roc", f"WITH {PREDS}, {POINTS} SELECT c, score, round((neg_above + neg)::DOUBLE / sum(neg) OVER (PARTITION BY c), 9) AS fpr, round((pos_above + pos)::DOUBLE / sum(pos) OVER (PARTITION BY c), 9) AS tpr FROM cum")
def agg_roc(spark, d):
    return M.roc(points(spark, d)).select("c", "score", r("fpr"), r("tpr"))


@query("agg_brier", f"WITH {PREDS}, q AS (SELECT id, sum((pa[c.range + 1] - CAST(y = c.range AS INTEGER)) * (pa[c.range + 1] - CAST(y = c.range AS INTEGER))) AS b FROM preds, range(4) c GROUP BY id) SELECT round(avg(b), 9) AS brier FROM q")
def agg_brier(spark, d):
    return M.brier(predictions(spark, d), K, "y", "pa").select(r("brier"))


BINS = "bins AS (SELECT CAST(b.range AS INTEGER) AS bin, b.range * 0.1::DOUBLE AS lower, (b.range + 1) * 0.1::DOUBLE AS upper, count(*) AS n, avg(CAST(ok AS DOUBLE)) AS accuracy, avg(conf_a) AS mean_confidence FROM gated JOIN range(10) b ON conf_a >= b.range * 0.1::DOUBLE AND (conf_a < (b.range + 1) * 0.1::DOUBLE OR b.range = 9) GROUP BY b.range)"


@query("agg_calbins", f"WITH {PREDS}, {BINS} SELECT bin, lower, upper, n, round(accuracy, 9) AS accuracy, round(mean_confidence, 9) AS mean_confidence FROM bins")
def agg_calbins(spark, d):
    return M.calibration(predictions(spark, d), 10, "y", "pa").select("bin", "lower", "upper", "n", r("accuracy"), r("mean_confidence"))


@query("agg_ece", f"WITH {PREDS}, {BINS} SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 9) AS ece FROM bins")
def agg_ece(spark, d):
    return M.ece(M.calibration(predictions(spark, d), 10, "y", "pa")).select(r("ece"))


@query("agg_qcal", f"""WITH {PREDS}, pts AS (SELECT CAST(c.range AS INTEGER) AS c, pa[c.range + 1] AS score, CAST(y = c.range AS INTEGER) AS hit FROM preds, range(4) c), q AS (SELECT c, quantile_cont(score, {doubles(tuple(i / 6 for i in range(1, 6)))}) AS edges FROM pts GROUP BY c),
b AS (SELECT c, score, hit, CAST(len(list_filter(edges, lambda e: score >= e)) AS INTEGER) AS bin FROM pts JOIN q USING (c)) SELECT c, bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(hit), 6) AS share FROM b GROUP BY c, bin""")
def agg_qcal(spark, d):
    return M.quantile_calibration(points(spark, d), 6).select("c", "bin", "n", r("mean_score", 6), r("share", 6))


@query("agg_referral", f"""WITH {PREDS}, m AS (SELECT 'single' AS rule, ok, single AS kept FROM gated UNION ALL SELECT 'full', ok, full_gate FROM gated)
SELECT rule, count(*) AS n, count_if(kept) AS retained_n, round(count_if(kept)::DOUBLE / count(*), 9) AS coverage, round(count_if(kept AND ok)::DOUBLE / nullif(count_if(kept), 0), 9) AS retained_accuracy,
count_if(NOT ok) AS errors_total, count_if(NOT ok AND NOT kept) AS errors_referred, round(count_if(NOT ok AND NOT kept)::DOUBLE / nullif(count_if(NOT ok), 0), 9) AS error_capture FROM m GROUP BY rule""")
def agg_referral(spark, d):
    m = gated(spark, d).select("ok", F.explode(F.create_map(F.lit("single"), "single", F.lit("full"), "full_gate")).alias("rule", "retained"))
    return R.totals(m, "rule").select("rule", "n", "retained_n", r("coverage"), r("retained_accuracy"), "errors_total", "errors_referred", r("error_capture"))


@query("agg_referral_cls", f"""WITH {PREDS}, t AS (SELECT y AS c, count(*) AS support, count_if(full_gate) AS retained, count_if(full_gate AND ok) AS hits, count_if(NOT ok) AS errors, count_if(NOT ok AND NOT full_gate) AS errors_referred FROM gated GROUP BY y), q AS (SELECT pred_a AS c, count_if(full_gate) AS predicted FROM gated GROUP BY pred_a)
SELECT t.c, support, retained, support - retained AS referred, round(retained::DOUBLE / support, 9) AS retained_fraction, round(hits::DOUBLE / support, 9) AS auto_correct_sensitivity, round(hits::DOUBLE / nullif(retained, 0), 9) AS retained_case_accuracy, round(hits::DOUBLE / nullif(predicted, 0), 9) AS retained_precision, hits, errors, errors_referred, round(errors_referred::DOUBLE / nullif(errors, 0), 9) AS error_capture FROM t LEFT JOIN q ON q.c = t.c""")
def agg_referral_cls(spark, d):
    x = R.by_class(gated(spark, d).withColumn("retained", F.col("full_gate")))
    return x.select("c", "support", "retained", "referred", *[r(c) for c in ("retained_fraction", "auto_correct_sensitivity", "retained_case_accuracy", "retained_precision")], "hits", "errors", "errors_referred", r("error_capture"))


@query("agg_curve", f"""WITH {PREDS}, g AS (SELECT unnest({doubles(TH)}) AS threshold), m AS (SELECT 'single' AS rule, threshold, ok, ent_a <= 0.65::DOUBLE AND conf_a >= threshold AS kept FROM gated, g
UNION ALL SELECT 'full', threshold, ok, ent_a <= 0.65::DOUBLE AND pred_a = pred_b AND conf_b >= 0.5::DOUBLE AND ent_b <= 0.75::DOUBLE AND conf_a >= threshold FROM gated, g)
SELECT rule, threshold, count_if(kept) AS retained_n, round(count_if(kept)::DOUBLE / count(*), 9) AS coverage, round(count_if(kept AND ok)::DOUBLE / nullif(count_if(kept), 0), 9) AS retained_accuracy, round(count_if(NOT ok AND NOT kept)::DOUBLE / greatest(1, count_if(NOT ok)), 9) AS error_capture FROM m GROUP BY rule, threshold""")
def agg_curve(spark, d):
    g = gated(spark, d)
    rest = (P.top("pb") >= 0.50) & (P.entropy("pb", K) <= 0.75) & (F.col("pred") == F.col("pred_b"))
    c = R.curve(g, TH, {"single": F.col("ent") <= 0.65, "full": (F.col("ent") <= 0.65) & rest})
    return c.select("rule", "threshold", "retained_n", r("coverage"), r("retained_accuracy"), r("error_capture"))


SWEEP = "sw AS (SELECT threshold, count_if(truth = 1 AND score >= threshold) AS tp, count_if(truth = 1 AND score < threshold) AS fn, count_if(truth <> 1 AND score < threshold) AS tn, count_if(truth <> 1 AND score >= threshold) AS fp FROM screened, g GROUP BY threshold)"


@query("agg_binary_sweep", f"""WITH {SCREENED}, g AS (SELECT unnest({doubles(BINARY)}) AS threshold), {SWEEP}
SELECT threshold, tp, fn, tn, fp, round((tp + tn)::DOUBLE / (tp + fn + tn + fp), 9) AS accuracy, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 9) AS specificity, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM sw""")
def agg_binary_sweep(spark, d):
    s = M.binary_sweep(screened(spark, d), BINARY)
    return s.select("threshold", "tp", "fn", "tn", "fp", *[r(c) for c in ("accuracy", "sensitivity", "specificity", "precision", "f1")])


@query("agg_netbenefit", f"""WITH {SCREENED}, g AS (SELECT unnest({doubles(DECISION)}) AS threshold), {SWEEP}, n AS (SELECT *, (tp + fn + tn + fp)::DOUBLE AS n, threshold / (1 - threshold) AS odds FROM sw)
SELECT threshold, round(tp / n - fp / n * odds, 9) AS model, round((tp + fn) / n - (tn + fp) / n * odds, 9) AS treat_all, 0::DOUBLE AS treat_none FROM n""")
def agg_netbenefit(spark, d):
    return M.net_benefit(M.binary_sweep(screened(spark, d), DECISION)).select("threshold", r("model"), r("treat_all"), "treat_none")


@query("agg_moments", """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95,
round(avg(z * z * z), 6) AS skew, round(avg(z * z * z * z) - 3, 6) AS kurtosis FROM (SELECT event_type, value, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events) GROUP BY event_type""")
def agg_moments(spark, d):
    from .registry import table

    m = M.moments(table(spark, d, "events"), "value", "event_type")
    return m.select("event_type", *[r(c, 6) for c in m.columns[1:]])


@query("agg_hist", "WITH b AS (SELECT event_type, CAST(least(floor((value - 0) / ((200::DOUBLE - 0) / 12)), 11) AS INTEGER) AS bin FROM events WHERE value >= 0 AND value <= 200), c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2) SELECT event_type, bin, round(n::DOUBLE / sum(n) OVER (PARTITION BY event_type), 9) AS share FROM c")
def agg_hist(spark, d):
    from .registry import table

    return M.histogram(table(spark, d, "events"), "value", 0.0, 200.0, 12, "event_type").select("event_type", "bin", r("share"))


@query("agg_centroid", "SELECT label, i.range AS dim, round(avg(embedding[i.range + 1]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i.range + 1]::DOUBLE), 6) AS std FROM embeddings, range(64) i GROUP BY label, i.range")
def agg_centroid(spark, d):
    from .registry import table

    c = M.centroids(table(spark, d, "embeddings"), "label", "embedding")
    c = c.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "x"))
    return c.select("label", F.col("dim").cast("long").alias("dim"), F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


@query("agg_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER () + 1e-9), 9) AS scaled FROM part")
def agg_minmax(spark, d):
    from .registry import table

    p = table(spark, d, "part")
    ends = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.crossJoin(F.broadcast(ends)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9), 9).alias("scaled"))


@query("agg_weight_balanced", f"WITH {PREDS} SELECT id, y, round((SELECT count(*) FROM preds)::DOUBLE / (4 * count(*) OVER (PARTITION BY y)), 9) AS weight FROM preds")
def agg_weight_balanced(spark, d):
    p = predictions(spark, d)
    n = p.groupBy("y").agg(F.count("*").alias("own"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("own").alias("every")))).select("y", F.round(F.col("every") / (F.col("own") * K), 9).alias("weight"))
    return p.join(F.broadcast(n), "y").select("id", "y", "weight")


@query("agg_delta", f"""WITH {PREDS}, m AS (SELECT avg(CAST(pred_a = y AS DOUBLE)) AS a, avg(CAST(pred_b = y AS DOUBLE)) AS b, avg(-ln(pa[y + 1])) AS la, avg(-ln(pb[y + 1])) AS lb, avg(conf_a) AS ca, avg(conf_b) AS cb FROM preds)
SELECT 'accuracy' AS metric, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS delta FROM m UNION ALL SELECT 'confidence', round(ca, 9), round(cb, 9), round(ca - cb, 9) FROM m UNION ALL SELECT 'log_loss', round(la, 9), round(lb, 9), round(la - lb, 9) FROM m""")
def agg_delta(spark, d):
    p = predictions(spark, d)

    def long(c: str, out: str) -> DataFrame:
        x = p.agg(F.avg((P.argmax(c) == F.col("y")).cast("double")).alias("accuracy"), F.avg(P.top(c)).alias("confidence"), F.avg(-F.ln(F.element_at(c, F.col("y") + 1))).alias("log_loss"))
        return x.unpivot([], ["accuracy", "confidence", "log_loss"], "metric", out)

    x = long("pa", "a").join(long("pb", "b"), "metric")
    return x.select("metric", r("a"), r("b"), F.round(F.col("a") - F.col("b"), 9).alias("delta"))


@query("win_topn_match", f"WITH {PREDS}, o AS (SELECT id, row_number() OVER (ORDER BY conf_a DESC, id) AS place FROM gated) SELECT id, place <= (SELECT count_if(full_gate) FROM gated) AS matched FROM o")
def win_topn_match(spark, d):
    g = gated(spark, d)
    n = g.agg(F.count_if("full_gate")).first()[0]
    return R.matched(g.select("id", "conf"), n).select("id", "matched")


@query("sort_topk_n", f"WITH {PREDS} SELECT id, conf_a AS conf FROM preds ORDER BY conf_a DESC, id LIMIT 10")
def sort_topk_n(spark, d):
    return gated(spark, d).select("id", "conf").orderBy(F.desc("conf"), "id").limit(10)


CURVE = "cv AS (SELECT threshold, count_if(conf_a >= threshold)::DOUBLE / count(*) AS coverage, count_if(conf_a >= threshold AND ok)::DOUBLE / nullif(count_if(conf_a >= threshold), 0) AS accuracy FROM gated, g GROUP BY threshold)"


@query("sort_two_level", f"WITH {PREDS}, g AS (SELECT unnest({doubles(DECISION)}) AS threshold), {CURVE}, t AS (SELECT * FROM cv ORDER BY accuracy DESC, threshold LIMIT 8) SELECT threshold, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, row_number() OVER (ORDER BY coverage DESC, threshold) AS place FROM t")
def sort_two_level(spark, d):
    c = R.curve(gated(spark, d), DECISION, {"all": F.lit(True)})
    t = c.orderBy(F.desc("retained_accuracy"), "threshold").limit(8)
    return t.select("threshold", r("coverage"), F.round("retained_accuracy", 9).alias("accuracy"), F.row_number().over(Window.orderBy(F.desc("coverage"), "threshold")).cast("long").alias("place"))


@query("nearest_row", f"WITH {PREDS}, g AS (SELECT unnest({doubles(DECISION)}) AS threshold), {CURVE} SELECT threshold, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy FROM cv ORDER BY abs(coverage - 0.6::DOUBLE) + abs(accuracy - 0.9::DOUBLE), threshold LIMIT 1")
def nearest_row(spark, d):
    c = R.curve(gated(spark, d), DECISION, {"all": F.lit(True)}).withColumn("far", F.abs(F.col("coverage") - 0.6) + F.abs(F.col("retained_accuracy") - 0.9))
    best = c.agg(F.min_by(F.struct("threshold", "coverage", "retained_accuracy"), F.struct("far", "threshold")).alias("x"))
    return best.select("x.threshold", F.round("x.coverage", 9).alias("coverage"), F.round("x.retained_accuracy", 9).alias("accuracy"))

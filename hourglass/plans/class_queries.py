"""Classification, thresholds, calibration and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as cl
from ..operators.grid import HOUR, with_label
from ..operators.ordered import with_frames
from . import bindings as b
from .catalog import Tables, query

_FH = f"""{b.INDEX_CTE}, f0 AS (SELECT entity, ts, lead(hourly_index, 6) OVER (PARTITION BY entity ORDER BY ts) AS y, hourly_index AS c,
    avg(hourly_index) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p FROM hourly),
  fh AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'val' ELSE 'test' END AS split FROM f0 WHERE y IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL)"""


def fh(t: Tables):
    """Six-hour forecasts of the hourly index (more spread than the trailing index): y, p (model), c (persistence), split."""
    f = with_frames(b.hourly(t), b.BY, HOUR, lambda w: {"y": w.at("hourly_index", 6), "c": F.col("hourly_index"), "p": w.mean("hourly_index", 3, 1)}, behind=3, ahead=6)
    f = with_label(f.select("entity", HOUR, "y", "c", "p")).where("y IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL")
    return f.withColumn("split", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "val").otherwise("test"))


def _cls(x: str) -> str:
    return f"(({x} >= 51)::INT + ({x} >= 101)::INT + ({x} >= 201)::INT + ({x} >= 301)::INT + ({x} >= 401)::INT)"


_CELLS = f"{_FH}, cells AS (SELECT {_cls('y')} AS t, {_cls('p')} AS p, count(*) AS n FROM fh GROUP BY ALL)"


@query("confusion_matrix", f"WITH {_CELLS} SELECT * FROM cells")
def confusion_matrix(t: Tables):
    """Six-class confusion cells."""
    return cl.confusion_cells(fh(t), [], "y", "p")


@query(
    "class_metrics",
    f"""WITH {_CELLS}, k AS (SELECT unnest(range(6)) AS c), pc AS (SELECT c, sum(n) FILTER (WHERE t = c AND p = c) AS tp0, sum(n) FILTER (WHERE t = c) AS a0, sum(n) FILTER (WHERE p = c) AS r0 FROM k, cells GROUP BY c),
      q AS (SELECT c, coalesce(tp0, 0)::DOUBLE AS tp, coalesce(a0, 0)::DOUBLE AS a, coalesce(r0, 0)::DOUBLE AS r FROM pc), f AS (SELECT *, CASE WHEN a + r > 0 THEN 2 * tp / (a + r) END AS f1, CASE WHEN a + r > 0 THEN CASE WHEN r > 0 THEN tp / r ELSE 0 END END AS pr, CASE WHEN a + r > 0 THEN CASE WHEN a > 0 THEN tp / a ELSE 0 END END AS rc FROM q),
      n AS (SELECT sum(n)::DOUBLE AS n FROM cells), mg AS (SELECT x.c AS i, y.c AS j, x.a / n * y.r / n AS pe FROM q x, q y, n),
      kp AS (SELECT 1 - (SELECT sum(power(t - p, 2) / 25.0 * n) FROM cells) / (SELECT n FROM n) / (SELECT sum(power(i - j, 2) / 25.0 * pe) FROM mg) AS weighted_kappa),
      v AS (SELECT coalesce(sum(n) FILTER (WHERE t >= 4 AND p >= 4), 0)::BIGINT AS vtp, coalesce(sum(n) FILTER (WHERE t < 4 AND p >= 4), 0)::BIGINT AS vfp, coalesce(sum(n) FILTER (WHERE t >= 4 AND p < 4), 0)::BIGINT AS vfn, coalesce(sum(n) FILTER (WHERE t = 5 AND p <= 2), 0) AS cm, sum(abs(t - p) * n) AS sad FROM cells),
      s AS (SELECT * FROM f WHERE c = 5)
    SELECT n.n::BIGINT AS n, (SELECT avg(f1) FROM f) AS macro_f1, (SELECT sum(a * coalesce(f1, 0)) FROM f) / n.n AS weighted_f1, (SELECT avg(pr) FROM f) AS macro_precision, (SELECT avg(rc) FROM f) AS macro_recall, weighted_kappa, sad / n.n AS ordinal_mae,
      s.f1 AS severe_f1, s.rc AS severe_recall, s.pr AS severe_precision, s.tp::BIGINT AS severe_tp, (s.r - s.tp)::BIGINT AS severe_fp, (s.a - s.tp)::BIGINT AS severe_fn, vtp AS vpoor_plus_tp, vfp AS vpoor_plus_fp, vfn AS vpoor_plus_fn,
      coalesce(vtp / nullif(vtp + vfn, 0), 0) AS vpoor_plus_recall, coalesce(vtp / nullif(vtp + vfp, 0), 0) AS vpoor_plus_precision, coalesce(2 * vtp / nullif(2 * vtp + vfp + vfn, 0), 0) AS vpoor_plus_f1, cm / nullif(s.a, 0) AS critical_miss_rate FROM n, kp, v, s""",
    "macro_f1 weighted_f1 macro_precision macro_recall weighted_kappa ordinal_mae severe_f1 severe_recall severe_precision vpoor_plus_recall vpoor_plus_precision vpoor_plus_f1 critical_miss_rate",
)
def class_metrics(t: Tables):
    """Every classification metric from the confusion cells."""
    return cl.class_metrics(cl.confusion_cells(fh(t), [], "y", "p"), [])


_AREAS = """rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM lab), tot AS (SELECT sum(hit)::DOUBLE AS P, count(*)::DOUBLE AS T, sum(r * hit) AS ranks FROM rk),
  ds AS (SELECT s, sum(hit) AS pos, count(*) AS n FROM lab GROUP BY s), ap AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fl FROM ds)
SELECT P::BIGINT AS positives, (ranks - P * (P + 1) / 2) / (P * (T - P)) AS auroc, (SELECT sum(pos * tp / fl) FROM ap) / P AS average_precision FROM tot"""


@query("ranking_areas", f"WITH {_FH}, lab AS (SELECT (y >= 301)::INT AS hit, p AS s FROM fh), {_AREAS}", "auroc average_precision")
def ranking_areas(t: Tables):
    """AUROC and average precision of the forecast for high hours."""
    return cl.ranking_areas(fh(t), [], F.col("y") >= 301, "p")


@query("label_ranking_areas", f"WITH lab AS (SELECT toxic AS hit, n_chars AS s FROM labels JOIN documents USING (doc_id)), {_AREAS}", "auroc average_precision")
def label_ranking_areas(t: Tables):
    """AUROC and average precision of an integer score with many ties against given labels."""
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return cl.ranking_areas(d, [], F.col("toxic") == 1, "n_chars")


_RATIOS = cl.COST_RATIOS
_SWEEP = f"""{_FH}, sl AS (SELECT split, greatest(-1, least(600, floor((p - 200) / 0.5)))::INT AS slot, count(*) FILTER (WHERE y >= 401) AS pos, count(*) FILTER (WHERE y < 401) AS neg,
    count(*) FILTER (WHERE y BETWEEN 301 AND 400) AS vpoor, count(*) FILTER (WHERE y BETWEEN 201 AND 300) AS poor, count(*) FILTER (WHERE y <= 200) AS better FROM fh GROUP BY ALL),
  gr AS (SELECT split, unnest(range(-1, 601))::INT AS slot FROM (SELECT DISTINCT split FROM fh)),
  cu AS (SELECT split, slot, sum(coalesce(pos, 0)) OVER d AS tp, sum(coalesce(neg, 0)) OVER d AS fp, sum(coalesce(pos, 0)) OVER w AS pos_all, sum(coalesce(neg, 0)) OVER w AS neg_all,
    sum(coalesce(vpoor, 0)) OVER d AS vp, sum(coalesce(poor, 0)) OVER d AS pr, sum(coalesce(better, 0)) OVER d AS bt FROM gr LEFT JOIN sl USING (split, slot) WINDOW d AS (PARTITION BY split ORDER BY slot DESC), w AS (PARTITION BY split)),
  cf AS (SELECT split, (200 + slot * 0.5)::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos_all - tp)::BIGINT AS fn, (neg_all - fp)::BIGINT AS tn, vp::BIGINT AS fp_actual_vpoor, pr::BIGINT AS fp_actual_poor, bt::BIGINT AS fp_actual_mod_better FROM cu WHERE slot >= 0),
  rt AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS fnr FROM cf),
  sweep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, {', '.join(f'fpr + fnr * {r} AS cost_rate_{r}x, (fp + fn * {r}) / (tp + fp + fn + tn) AS cost_sample_{r}x' for r in _RATIOS)} FROM rt)"""
_RATES = "precision recall f1 fpr fnr"


def _sweep(t: Tables):
    return cl.threshold_sweep(fh(t), ["split"], "y", "p", ratios=_RATIOS)


@query("threshold_sweep", f"WITH {_SWEEP} SELECT * FROM sweep", f"threshold {_RATES} " + " ".join(f"cost_rate_{r}x cost_sample_{r}x" for r in _RATIOS))
def threshold_sweep(t: Tables):
    """Confusion, rates, false-alarm mix and costs at 601 thresholds per split."""
    return _sweep(t)


_OPT = f"""{_SWEEP}, lc AS ({' UNION ALL '.join(f'SELECT split, {r} AS ratio, threshold, cost_rate_{r}x AS cost FROM sweep' for r in _RATIOS)}),
  best AS (SELECT split, ratio, threshold AS optimal_threshold, cost AS cost_rate FROM lc QUALIFY row_number() OVER (PARTITION BY split, ratio ORDER BY round(cost, 12), threshold) = 1),
  opt AS (SELECT b.split, b.ratio, optimal_threshold, optimal_threshold - 401 AS shift, cost_rate, o.cost AS official_cost, CASE WHEN o.cost > 0 THEN 100 * (o.cost - cost_rate) / o.cost END AS reduction_pct FROM best b JOIN lc o ON o.split = b.split AND o.ratio = b.ratio AND o.threshold = 401)"""
_OPTC = "optimal_threshold shift cost_rate official_cost reduction_pct"


@query("cost_optimal_thresholds", f"WITH {_OPT} SELECT * FROM opt", _OPTC)
def cost_optimal_thresholds(t: Tables):
    """Cheapest threshold per cost ratio and split."""
    return cl.cost_optimal(_sweep(t), ["split"], ratios=_RATIOS)


@query(
    "thresholds_applied",
    f"WITH {_OPT} SELECT o.ratio, o.optimal_threshold, o.cost_rate, s.tp, s.fp, s.fn, s.tn, s.precision, s.recall, s.f1, s.fpr, s.fnr FROM opt o JOIN sweep s ON s.split = 'test' AND s.threshold = o.optimal_threshold WHERE o.split = 'val'",
    f"optimal_threshold cost_rate {_RATES}",
)
def thresholds_applied(t: Tables):
    """Thresholds chosen on validation applied once to test."""
    chosen = cl.cost_optimal(cl.threshold_sweep(fh(t).where("split = 'val'"), ["split"], "y", "p", ratios=_RATIOS), [], ratios=_RATIOS)
    test = cl.threshold_sweep(fh(t).where("split = 'test'"), ["split"], "y", "p", ratios=_RATIOS)
    out = cl.apply_thresholds(chosen.select("ratio", "optimal_threshold", "cost_rate"), test)
    return out.select("ratio", "optimal_threshold", "cost_rate", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "fnr")


@query("operating_points", f"WITH {_SWEEP} SELECT split, threshold, tp, fp, fn, recall, precision FROM sweep WHERE threshold IN ({', '.join(map(str, cl.OPERATING_POINTS))})", "threshold recall precision")
def operating_points(t: Tables):
    """Standard thresholds on both splits."""
    return cl.operating_points(_sweep(t)).select("split", "threshold", "tp", "fp", "fn", "recall", "precision")


_BAND = f"""{_FH}, q AS (SELECT quantile_cont(y - c, 0.1) AS lo, quantile_cont(y - c, 0.9) AS hi FROM fh WHERE split = 'val'), band AS (SELECT fh.*, c + lo AS bl, c + hi AS bh FROM fh, q)"""


@query(
    "persistence_band",
    f"""WITH {_BAND} SELECT split, count(*) AS n, avg(greatest(0.1 * (y - bl), -0.9 * (y - bl))) AS pinball_low, avg(greatest(0.9 * (y - bh), -0.1 * (y - bh))) AS pinball_high, avg((y BETWEEN bl AND bh)::INT) AS coverage, avg(bh - bl) AS mean_width FROM band GROUP BY 1""",
    "pinball_low pinball_high coverage mean_width",
)
def persistence_band(t: Tables):
    """Interval from train residual quantiles, scored by pinball loss, coverage and width."""
    f = fh(t)
    band = cl.persistence_band(f.where("split = 'val'"), f, "y", "c")
    return cl.interval_scores(band, ["split"], "y", "band_low", "band_high")


@query(
    "conformal_pad",
    f"""WITH {_FH}, s AS (SELECT split, greatest(p - 20 - y, y - (p + 20)) AS score FROM fh), o AS (SELECT split, score, row_number() OVER (PARTITION BY split ORDER BY score) AS i, count(*) OVER (PARTITION BY split) AS n FROM s)
    SELECT split, n, ceil((n + 1) * 0.8)::BIGINT AS k, greatest(score, 0) AS pad FROM o WHERE i = ceil((n + 1) * 0.8)""",
    "pad",
)
def conformal_pad(t: Tables):
    """Split-conformal pad per split."""
    f = fh(t).select("split", "y", (F.col("p") - 20).alias("lo"), (F.col("p") + 20).alias("hi"))
    return cl.conformal_pad(f, ["split"], "y", "lo", "hi", 0.8)


@query(
    "reliability_table",
    f"""WITH {_FH}, r AS (SELECT (y >= 250)::INT AS o, least(p / 500, 1) AS pr FROM fh) SELECT least(9, floor(pr * 10))::INT AS bin, count(*) AS n, avg(pr) AS mean_predicted, avg(o) AS observed_rate FROM r GROUP BY 1""",
    "mean_predicted observed_rate",
)
def reliability_table(t: Tables):
    """Reliability of a probability forecast in ten bins."""
    f = fh(t).select((F.col("y") >= 250).alias("o"), F.least(F.col("p") / 500, F.lit(1.0)).alias("pr"))
    return cl.reliability_table(f, [], "o", "pr")


@query(
    "neighbourhood_rate",
    f"""WITH {_FH}, tr AS (SELECT round((c + 1e-7) * 1000)::BIGINT AS c, (y >= 250)::INT AS o FROM fh WHERE split = 'val'), te AS (SELECT entity, ts, round((c + 1e-7) * 1000)::BIGINT AS c FROM fh WHERE split = 'test')
    SELECT te.entity, te.ts, coalesce(avg(tr.o), (SELECT avg(o) FROM tr)) AS rate FROM te LEFT JOIN tr ON tr.c - te.c BETWEEN -25000 AND 25000 GROUP BY ALL""",
    "rate",
)
def neighbourhood_rate(t: Tables):
    """Event share among train rows within 25 of the current value (values on a 0.001 grid)."""
    f = fh(t).select("entity", "ts", "split", F.round((F.col("c") + 1e-7) * 1000).cast("long").alias("c"), (F.col("y") >= 250).alias("o"))
    out = cl.neighbourhood_rate(f.where("split = 'val'"), f.where("split = 'test'"), "c", "o", "rate", radius=25000, block=250)
    return out.select("entity", "ts", "rate")


@query(
    "missing_share_gate",
    f"""WITH {b.READINGS_CTE}, m AS (SELECT ((pm10 IS NULL)::INT + (no2 IS NULL)::INT + (co IS NULL)::INT + (o3 IS NULL)::INT) / 4.0 AS share FROM readings) SELECT quantile_cont(share::DOUBLE, 0.99) AS raw, ceil(quantile_cont(share::DOUBLE, 0.99) * 100) / 100 AS gate FROM m""",
    "raw gate",
)
def missing_share_gate(t: Tables):
    """99th percentile of the missing share, rounded up."""
    return cl.gate_level(b.readings(t).select(cl.missing_share(["pm10", "no2", "co", "o3"]).alias("share")), "share")

"""Forecast models on Spark ML: ridge blend, trees in level or residual form, classifier, isotonic calibration.

Fits are iterative, so their training rows are checkpointed once; predictions stay lazy column work.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from .cross_products import LinearModel, cross_products, medians
from .isotonic import isotonic_fit
from .lineage import cut_lineage
from .scoring import paired_difference, regression_metrics

ALPHA = 1000.0
BLEND = 0.5


def _typed(df: DataFrame, features: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    names = list(dict.fromkeys([*keep, *features]))
    return df.select(*[F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in names])


def _prepare(features: Sequence[str], *, scale: bool) -> list:
    filled = [f"{c}__filled" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="raw_vector"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True))
    return stages


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, *, alpha: float = ALPHA) -> PipelineModel:
    """Train-only median imputation, z-scores and ridge.

    ``alpha`` penalises the summed squared error on z-scores by population deviation; Spark's parameter is per row, on a
    standardised label, and its scaler divides by the sample deviation, hence the factors.
    """
    rows = cut_lineage(_typed(train.where(F.col(target).isNotNull()), features, [target]))
    n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    reg = alpha * (n - 1) / n / n * spread
    ridge = LinearRegression(featuresCol="vector", labelCol=target, predictionCol="prediction", regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal")
    return Pipeline(stages=[*_prepare(features, scale=True), ridge]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], *, keep: Sequence[str], out: str = "prediction") -> DataFrame:
    """Keep columns plus the prediction; helper columns are dropped."""
    return model.transform(_typed(df, features, keep)).select(*keep, F.col("prediction").alias(out))


def blend(prediction: Column | str, persistence: Column | str, weight: float = BLEND) -> Column:
    """Weighted mean with persistence."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    c = F.col(persistence) if isinstance(persistence, str) else persistence
    return F.lit(weight) * c + F.lit(1.0 - weight) * p


def _present(target: str) -> Column:
    y = F.col(target).cast("double")
    return y.isNotNull() & ~F.isnan(y)


def _scored(rows: DataFrame, models: Sequence[tuple[Mapping[str, object], Column]], keep: Sequence[str | Column], out: str = "p") -> DataFrame:
    """Every model's prediction of every row, unpivoted inside the row: the labels of each model as columns, and the prediction."""
    cells = [F.struct(*[F.lit(v).alias(k) for k, v in labels.items()], p.alias(out)) for labels, p in models]
    return rows.select(*keep, F.inline(F.array(*cells)))


def alpha_sweep(train: DataFrame, val: DataFrame, features: Sequence[str], target: str, current: str, alphas: Sequence[float]) -> DataFrame:
    """Validation metrics of the ridge and of its blend per penalty: one pass for the medians, one for the products of all fits, one
    over the validation rows for all scores."""
    train = cut_lineage(_typed(train.where(_present(target)), features, [target])).withColumn("__g", F.lit("train"))
    fill = medians(train, "__g", features)["train"]
    products = cross_products(train, features, [target], F.col("__g"), fill)
    models = []
    for a in alphas:
        p = products.ridge(["train"], target, fill, alpha=a)[0].expr()
        models += [({"alpha": float(a), "model": "ridge"}, p), ({"alpha": float(a), "model": "blend"}, blend(p, current))]
    return regression_metrics(_scored(val, models, [target]), ["alpha", "model"], target, "p").select("alpha", "model", "n", "mae", "rmse", "r2")


def blend_grid(df: DataFrame, target: str, prediction: str, current: str, *, steps: int = 20) -> DataFrame:
    """Metrics of every blend weight in one pass: each row is scored once per weight inside its task."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(float(steps)))
    rows = df.select(target, prediction, current, F.explode(weights).alias("weight_naive"))
    mixed = rows.withColumn("p", F.col("weight_naive") * F.col(current) + (1 - F.col("weight_naive")) * F.col(prediction))
    return regression_metrics(mixed, ["weight_naive"], target, "p").select("weight_naive", "n", "mae", "rmse", "r2", "bias", "mae_extreme", "mae_severe")


def feature_sets(base: Sequence[str], rolling: Sequence[str], deltas: Sequence[str], spatial: Sequence[str], refined: Sequence[str]) -> dict[str, list[str]]:
    """Nested candidate sets and a curated one."""
    a = list(base)
    b, c = a + list(rolling), a + list(rolling) + list(deltas)
    return {"A": a, "B": b, "C": c, "D": c + list(spatial), "refined": list(dict.fromkeys(b + list(refined)))}


def compare_feature_sets(train: DataFrame, val: DataFrame, sets: Mapping[str, Sequence[str]], target: str, current: str, *, alpha: float = ALPHA) -> DataFrame:
    """Validation metrics of the ridge blend per feature set; every set is a sub-matrix of the same products."""
    every = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    train = cut_lineage(_typed(train.where(_present(target)), every, [target])).withColumn("__g", F.lit("train"))
    fill = medians(train, "__g", every)["train"]
    products = cross_products(train, every, [target], F.col("__g"), fill)
    models = [({"feature_set": name, "features": len(fs)}, blend(products.ridge(["train"], target, fill, list(dict.fromkeys(fs)), alpha=alpha)[0].expr(), current)) for name, fs in sets.items()]
    return regression_metrics(_scored(val, models, [target]), ["feature_set", "features"], target, "p").select("feature_set", "features", "n", "mae", "rmse", "r2")


def fit_trees(train: DataFrame, features: Sequence[str], target: str, *, current: str, form: str = "level", trees: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees on the level, or on the change from the current value."""
    label = F.col(target) - F.col(current) if form == "delta" else F.col(target)
    rows = cut_lineage(_typed(train.where(F.col(target).isNotNull() & F.col(current).isNotNull()).withColumn("__label", label), features, ["__label"]))
    gbt = GBTRegressor(featuresCol="raw_vector", labelCol="__label", predictionCol="prediction", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_prepare(features, scale=False), gbt]).fit(rows)


def predict_trees(model: PipelineModel, df: DataFrame, features: Sequence[str], *, current: str, form: str, keep: Sequence[str]) -> DataFrame:
    p = predict(model, df, features, keep=[*keep, *([] if current in keep else [current])])
    return p.withColumn("prediction", F.col("prediction") + F.col(current)) if form == "delta" else p


def tree_variants(train: DataFrame, val: DataFrame, features: Sequence[str], calendar: Sequence[str], target: str, current: str, *, trees: int = 20, ridge: bool = True) -> DataFrame:
    """Level / delta form, with and without calendar columns, next to the ridge; chosen by validation MAE."""
    every = list(dict.fromkeys([*features, *calendar]))
    train, val = cut_lineage(_typed(train, every, [target, current])), cut_lineage(_typed(val, every, [target, current]))
    out = None
    for with_calendar in (False, True):
        cols = [*features, *calendar] if with_calendar else list(features)
        for form in ("level", "delta"):
            model = fit_trees(train, cols, target, current=current, form=form, trees=trees)
            p = predict_trees(model, val, cols, current=current, form=form, keep=[target, current])
            rows = p.select(F.lit(f"trees_{form}").alias("model"), F.lit(with_calendar).alias("calendar"), target, F.col("prediction").alias("p"))
            out = rows if out is None else out.unionByName(rows)
    if ridge:
        p = predict(fit_ridge(train, features, target), val, features, keep=[target, current])
        out = out.unionByName(p.select(F.lit("ridge_blend").alias("model"), F.lit(False).alias("calendar"), target, blend("prediction", current).alias("p")))
    table = regression_metrics(out, ["model", "calendar"], target, "p").select("model", "calendar", "n", "mae", "rmse", "r2")
    best = table.agg(F.min(F.struct("mae", "model", "calendar")).alias("b"))
    chosen = best.select("b.mae").scalar()
    return table.withColumn("selected", F.col("mae") == chosen)


def group_ablation(train: DataFrame, val: DataFrame, groups: Mapping[str, Sequence[str]], target: str, current: str, *, trees: int = 10, ineligible: Sequence[str] = (), form: str = "level") -> DataFrame:
    """Metrics of boosted trees per cumulative or alternative feature group; oracle groups are never eligible.

    A group without columns is reported as not run.
    """
    every = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    train, val = cut_lineage(_typed(train, every, [target, current])), cut_lineage(_typed(val, every, [target, current]))
    out, skipped = None, []
    for name, cols in groups.items():
        if not cols:
            skipped.append((name, 0, None, None, None, False, "not_run"))
            continue
        model = fit_trees(train, cols, target, current=current, form=form, trees=trees)
        p = predict_trees(model, val, cols, current=current, form=form, keep=[target, current])
        rows = p.select(F.lit(name).alias("group"), F.lit(len(cols)).alias("features"), target, F.col("prediction").alias("p"))
        out = rows if out is None else out.unionByName(rows)
    done = regression_metrics(out, ["group", "features"], target, "p").select(
        "group", "features", "n", "mae", "rmse", (~F.col("group").isin(*ineligible) if ineligible else F.lit(True)).alias("eligible"), F.lit("run").alias("state")
    )
    if not skipped:
        return done
    return done.unionByName(train.sparkSession.createDataFrame(skipped, "group string, features int, n long, mae double, rmse double, eligible boolean, state string"))


ABLATION = "panel string, family string, group string, split string, n_train long, n_features int, status string, mae double, rmse double, r2 double, mae_delta_vs_baseline double, deployable boolean"


def exogenous_ablation(
    train: DataFrame, parts: Mapping[str, DataFrame], panels: Mapping[str, tuple[Column, Mapping[str, Sequence[str] | None]]], target: str, current: str, *,
    oracle: Sequence[str] = (), families: Sequence[str] = ("ridge_hybrid", "trees_delta"), baseline: str = "baseline", alpha: float = ALPHA, trees: int = 10,
) -> DataFrame:
    """Validation scores of every panel x family x feature group, and test scores of the chosen one and of its baseline.

    ``panels`` name a condition on train rows and their groups of columns; a group without columns (None or empty) is reported as
    ``not_run``. All ridge fits come from one pass over train: rows are grouped by the panels that hold them, and groups are
    sub-matrices. The choice is the smallest validation MAE of a group outside ``oracle`` (the first listed among equals); the test
    part is scored for that choice and its baseline only. Rows of the result: one per configuration.
    """
    spark = train.sparkSession
    every = list(dict.fromkeys(c for _, groups in panels.values() for cs in groups.values() for c in cs or ()))
    flags = [F.coalesce(condition, F.lit(False)) for condition, _ in panels.values()]
    member = F.concat(*[f.cast("int").cast("string") for f in flags])
    rows = cut_lineage(_typed(train.where(_present(target)).withColumn("__member", member), every, [target, current, "__member"]))
    held = F.array_compact(F.array(*[F.when(F.substring("__member", i + 1, 1) == "1", F.lit(name)) for i, name in enumerate(panels)]))
    fill = medians(rows.select(F.explode(held).alias("__panel"), *every), "__panel", every)
    first = next(iter(panels))
    products = cross_products(rows, every, [target], F.col("__member"), fill.get(first, {}))
    masks = {name: sorted({m for m, _ in products.sums if m[i] == "1"}) for i, name in enumerate(panels)}

    listed, skipped, fitted = [], [], {}
    for i, (panel, (_, groups)) in enumerate(panels.items()):
        n_train = int(round(sum(products.sums[m, target][0, 0] for m in masks[panel])))
        for family in families:
            for group, cols in groups.items():
                labels = {"panel": panel, "family": family, "group": group}
                if not cols:
                    skipped.append((panel, family, group, "val", n_train, None, "not_run", None, None, None, None, None))
                    continue
                cols = list(dict.fromkeys(cols))
                listed.append((panel, family, group, n_train, len(cols)))
                if family == "ridge_hybrid":
                    fitted[panel, family, group] = labels, products.ridge(masks[panel], target, fill[panel], cols, alpha=alpha)[0]
                else:
                    mine = rows.where(F.substring("__member", i + 1, 1) == "1")
                    fitted[panel, family, group] = labels, (fit_trees(mine, cols, target, current=current, form="delta", trees=trees), cols)

    def metrics(part: DataFrame, keys: Sequence[tuple]) -> dict[tuple, tuple]:
        part = cut_lineage(_typed(part.where(_present(target)), every, [target, current]))
        lines = [fitted[k] for k in keys if isinstance(fitted[k][1], LinearModel)]
        out = _scored(part, [(labels, blend(model.expr(), current)) for labels, model in lines], [target]) if lines else None
        for labels, model in (fitted[k] for k in keys if not isinstance(fitted[k][1], LinearModel)):
            p = predict_trees(model[0], part, model[1], current=current, form="delta", keep=[target, current])
            p = p.select(target, *[F.lit(v).alias(k) for k, v in labels.items()], F.col("prediction").alias("p"))
            out = p if out is None else out.unionByName(p)
        scores = regression_metrics(out, ["panel", "family", "group"], target, "p").collect()  # one row per configuration
        return {(r.panel, r.family, r.group): (r.mae, r.rmse, r.r2) for r in scores}

    val = metrics(parts["val"], list(fitted))
    table = []
    for panel, family, group, n_train, n_features in listed:
        m = val.get((panel, family, group), (None,) * 3)
        base = val.get((panel, family, baseline), (None,))[0]
        delta = None if m[0] is None or base is None else m[0] - base
        table.append((panel, family, group, "val", n_train, n_features, "ok", *m, delta, group not in oracle))
    open_ = [r for r in table if r[-1] and r[7] is not None]
    if open_:
        best = min(open_, key=lambda r: r[7])
        wanted = list(dict.fromkeys([best[:3], (*best[:2], baseline)]))
        wanted = [k for k in wanted if k in fitted]
        test = metrics(parts["test"], wanted)
        sizes = {(r[0], r[1], r[2]): (r[4], r[5]) for r in table}
        table += [(*k, "test", *sizes[k], "ok", *test.get(k, (None,) * 3), None, True) for k in wanted]
    return spark.createDataFrame([*table, *skipped], ABLATION)


def fit_event_classifier(train: DataFrame, features: Sequence[str], outcome: str, *, kind: str = "logistic", trees: int = 10) -> PipelineModel:
    """Probability of a severe event, by logistic regression or boosted trees."""
    rows = cut_lineage(_typed(train.withColumn("__label", F.col(outcome).cast("double")), features, ["__label"]))
    if kind == "trees":
        stages = [*_prepare(features, scale=False), GBTClassifier(featuresCol="raw_vector", labelCol="__label", maxIter=trees, maxDepth=3, seed=42)]
    else:
        stages = [*_prepare(features, scale=True), LogisticRegression(featuresCol="vector", labelCol="__label", regParam=1e-3)]
    return Pipeline(stages=stages).fit(rows)


def event_probability(model: PipelineModel, df: DataFrame, features: Sequence[str], *, keep: Sequence[str], out: str = "probability") -> DataFrame:
    scored = model.transform(_typed(df, features, keep))
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def calibration_report(fit_rows: DataFrame, parts: Mapping[str, DataFrame], feature: str, label: str) -> DataFrame:
    """Error and bias before and after calibration per part."""
    fit = isotonic_fit(fit_rows, feature, label)
    out = None
    for name, part in parts.items():
        rows = fit.apply(part.where(F.col(feature).isNotNull() & F.col(label).isNotNull()), feature, "calibrated").select(F.lit(name).alias("rows"), (F.col(feature) - F.col(label)).alias("b"), (F.col("calibrated") - F.col(label)).alias("a"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("rows").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("b")).alias("mae_before"), F.avg("b").alias("bias_before"), F.avg(F.abs("a")).alias("mae_after"), F.avg("a").alias("bias_after")
    )


def rolling_origin(frame: DataFrame, ts: str, folds: Sequence[tuple[str, str, str]], features: Sequence[str], target: str, current: str, *, embargo: int = 24, alpha: float = ALPHA) -> DataFrame:
    """Test predictions of every fold (expanding train, fixed test): columns fold, ts, target, current, prediction, n_train.

    Rows are put into the periods between the ends of the train sets; products are summed per period in one pass, and the train set
    of a fold is the sum of the periods before its end. A test row appears once per fold that tests it.
    """
    cut = {name: F.lit(first).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(embargo)} HOURS") for name, first, _ in folds}
    order = sorted(folds, key=lambda f: f[1])
    rank = {name: i for i, (name, _, _) in enumerate(order)}
    period = sum((F.col(ts) >= cut[name]).cast("int") for name, _, _ in order)
    rows = cut_lineage(_typed(frame.where(_present(target)).withColumn("__period", period), features, [ts, target, current, "__period"]))
    serves = F.explode(F.filter(F.array(*[F.lit(n) for n, _, _ in order]), lambda x, i: i >= F.col("__period"))).alias("__fold")
    fill = medians(rows.where(F.col("__period") < len(order)).select(serves, *features), "__fold", features)
    products = cross_products(rows.where(F.col("__period") < len(order)), features, [target], F.col("__period"), fill[order[-1][0]] if fill else {})
    cells = []
    for name, first, last in folds:
        model, n = products.ridge([str(p) for p in range(rank[name] + 1)], target, fill.get(name, {}), alpha=alpha)
        inside = F.col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
        cells.append(F.struct(F.lit(name).alias("fold"), inside.alias("__in"), blend(model.expr(), current).alias("prediction"), F.lit(n).cast("long").alias("n_train")))
    return rows.select(ts, target, current, F.inline(F.array(*cells))).where("__in").drop("__in")


def fold_scores(predictions: DataFrame, target: str, current: str) -> DataFrame:
    """Metrics of the blend and of persistence and both skills, one row per fold."""
    kept = predictions.where(F.col(current).isNotNull())
    mine = regression_metrics(kept, ["fold", "n_train"], target, "prediction").select("fold", "n_train", F.col("n").alias("n_test"), "mae", "rmse", "r2")
    naive = regression_metrics(kept, ["fold"], target, current).select("fold", F.col("mae").alias("persistence_mae"), F.col("rmse").alias("persistence_rmse"))
    skill = lambda m: F.when(F.col(f"persistence_{m}") > 0, 1 - F.col(m) / F.col(f"persistence_{m}")).alias(f"skill_{m}")
    return mine.join(naive, "fold").select("*", skill("mae"), skill("rmse"))


def fold_summary(scores: DataFrame, *values: str) -> DataFrame:
    """Mean and population deviation of scores over folds."""
    spread = [a for v in values for a in (F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"std_{v}"))]
    return scores.agg(*spread, F.count(F.lit(1)).alias("folds"))


def availability_audit(
    train: DataFrame, val: DataFrame, scenarios: Mapping[str, Mapping[object, Sequence[str]]], horizons: Mapping[int, str], features: Sequence[str],
    entity: str, ts: str, current: str, window_end: str, *, alpha: float = ALPHA, draws: int = 1000, everyone: object = "*",
) -> DataFrame:
    """What missing inputs cost: every scenario x horizon x row set, against the unmasked prediction of the same rows.

    ``scenarios`` map an entity (or ``everyone``) to the columns it loses; a lost value is filled like any gap. One pass over train
    gives the models of all horizons. One pass over val scores them: a row carries the predictions of all scenarios and
    horizons as an array, and the row sets (``all``; ``strict``: the label also lies inside the window) as flags. A scenario without
    gaps has difference 0. Rows without a current value are in no row set.
    """
    targets = list(horizons.values())
    rows = cut_lineage(_typed(train, features, targets))
    has = F.explode(F.array_compact(F.array(*[F.when(_present(t), F.lit(t)) for t in targets]))).alias("__target")
    fill = medians(rows.select(has, *features), "__target", features)
    products = cross_products(rows, features, targets, F.lit("train"), fill.get(targets[0], {}))
    end = F.lit(window_end).cast("timestamp_ntz")
    fitted = {hours: products.ridge(["train"], target, fill[target], alpha=alpha)[0] for hours, target in horizons.items()}
    names = sorted({c for gaps in scenarios.values() for cs in gaps.values() for c in cs})
    where = {
        (name, c): F.lit(True) if c in gaps.get(everyone, ()) else F.col(entity).isin(*[e for e, cs in gaps.items() if c in cs])
        for name, gaps in scenarios.items() for c in names if any(c in cs for cs in gaps.values())
    }
    predicted = [blend(m.expr(), current).alias(f"__base_{h}") for h, m in fitted.items()]
    changed = [((1 - BLEND) * m.change({c: w for (s, c), w in where.items() if s == name})).alias(f"__change_{h}_{i}") for h, m in fitted.items() for i, name in enumerate(scenarios)]
    kept = val.where(F.col(current).isNotNull()).select(ts, current, *targets, *predicted, *changed)
    cells = []
    for hours, target in horizons.items():
        strict = F.col(ts) + F.expr(f"INTERVAL {int(hours)} HOURS") <= end
        for i, name in enumerate(scenarios):
            p = F.col(f"__base_{hours}") + F.col(f"__change_{hours}_{i}")
            shared = [F.lit(int(hours)).alias("horizon"), F.lit(name).alias("scenario"), F.col(target).cast("double").alias("__y"), p.alias("__p"), F.col(f"__base_{hours}").alias("__base")]
            cells += [F.struct(F.lit(s).alias("row_set"), *shared, inside.alias("__in")) for s, inside in (("all", F.lit(True)), ("strict", strict))]
    scored = kept.select(F.to_date(ts).alias("__day"), F.col(current).cast("double").alias("__now"), F.inline(F.array(*cells)))
    scored = scored.where(F.col("__in") & F.col("__y").isNotNull() & ~F.isnan("__y"))
    return paired_difference(scored, ["horizon", "row_set", "scenario"], F.col("__day"), "__y", "__p", "__base", "__now", draws=draws)


def scenario_predictions(model: PipelineModel, scenarios: Mapping[str, DataFrame], features: Sequence[str], keys: Sequence[str], target: str, current: str) -> DataFrame:
    """Predictions of one model on every scenario's rows, cut to the keys all scenarios share."""
    from .tables import common_keys

    shared = common_keys(list(scenarios.values()), keys)
    out = None
    for name, frame in scenarios.items():
        rows = frame.join(shared, list(keys), "left_semi")
        p = predict(model, rows, features, keep=[*keys, target, current]).withColumn("prediction", blend("prediction", current))
        p = p.withColumn("scenario", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def importance_table(model: PipelineModel, features: Sequence[str], rows: DataFrame) -> DataFrame:
    """Split gains of a tree model, one row per feature (as many rows as features)."""
    gains = model.stages[-1].featureImportances.toArray()
    return rows.sparkSession.createDataFrame([(f, float(g)) for f, g in zip(features, gains, strict=True)], "feature string, gain double")


def replay(features_frame: DataFrame, model: PipelineModel, features: Sequence[str], by: Sequence[str], current: str, *, hours: int = 336, min_rows: int = 169, horizon: int = 6) -> DataFrame:
    """Forecasts for every issue hour at once.

    Features only look back, so a cut at each issue hour is implied; the eligibility rule is the number of index rows in
    the preceding window, counted by a frame instead of a loop over hours.
    """
    from .grid import HOUR
    from .ordered import with_frames

    counted = with_frames(features_frame, by, HOUR, lambda f: {"history_rows": F.count(F.col(current)).over(f.trailing(hours))}, behind=hours)
    ready = counted.where(F.col("history_rows") >= min_rows)
    p = predict(model, ready, features, keep=[*by, HOUR, current])
    return p.select(*by, HOUR, (F.col(HOUR) + horizon).alias("target_hour"), blend("prediction", current).alias("y_hat"), F.col(current).alias("y_persistence"))

"""The index, category and stage rules as functions that SQL text can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .piecewise import CATEGORY_LABELS, CATEGORY_UPPER, CLASS_LOWER, CONCENTRATION_KNOTS, INDEX_KNOTS, STAGE_LOWER


def _map_sql(x: str, xs, ys) -> str:
    arms = " ".join(f"WHEN {x} < {float(x1)}D THEN {(y1 - y0) / (x1 - x0)!r}D * ({x} - {float(x0)}D) + {float(y0)}D" for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False))
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} <= {float(xs[0])}D THEN {float(ys[0])}D {arms} ELSE {float(ys[-1])}D END"


def definitions() -> dict[str, tuple[str, str]]:
    """Function name -> (result type, expression in ``x``)."""
    out = {f"sub_index_{p}": ("DOUBLE", _map_sql("x", knots, INDEX_KNOTS)) for p, knots in CONCENTRATION_KNOTS.items()}
    upper = " ".join(f"WHEN x <= {u} THEN '{label}'" for u, label in zip(CATEGORY_UPPER, CATEGORY_LABELS, strict=False))
    out["index_category"] = ("STRING", f"CASE WHEN x IS NULL THEN NULL {upper} ELSE '{CATEGORY_LABELS[-1]}' END")
    out["index_class"] = ("INT", "CASE WHEN x IS NOT NULL THEN " + " + ".join(f"CAST(x >= {cut} AS INT)" for cut in CLASS_LOWER) + " END")
    out["stage_number"] = ("INT", "CASE WHEN x IS NULL THEN NULL WHEN x > 450 THEN 4 WHEN x >= 401 THEN 3 WHEN x >= 301 THEN 2 WHEN x >= 201 THEN 1 ELSE 0 END")
    stages = " ".join(f"WHEN CAST(x AS BIGINT) >= {low} THEN '{label}'" for label, low in reversed(STAGE_LOWER.items()))
    out["stage_label"] = ("STRING", f"CASE {stages} END")
    return out


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions of the session; they are inlined, so nothing leaves generated code."""
    for name, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS {kind} RETURN {body}")
    return list(definitions())

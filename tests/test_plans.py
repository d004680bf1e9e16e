"""Static plans of queries that branch from one expensive input: how often they read the source and shuffle."""

import pytest

from hourglass.plans.catalog import load_all

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gate_evidence", "gate_verdicts", "negative_streaks", "alert_table", "persistence_band"])
def test_one_scan_per_source(spark, name):
    df = load_all()[name].run(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 6, plan.count("FileScan parquet")


def test_model_intervals_use_all_draws(spark, monkeypatch):
    from unittest.mock import MagicMock

    from hourglass.plans import model_queries as mq

    for name in ("model_frame", "md", "sc"):
        monkeypatch.setattr(mq, name, MagicMock())
    monkeypatch.setattr(mq, "_parts", lambda f: (f, f, f))
    mq.ridge_blend(None)
    mq.rolling_origin(None)
    assert [c.kwargs["draws"] for c in mq.sc.skill_intervals.call_args_list] == [1000, 1000]

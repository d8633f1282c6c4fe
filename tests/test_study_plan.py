"""End-to-end study plan on the smallest order tables."""

import tempfile

from tessera.plans.study import run_study
from tessera.sources import testdata as td

SF001 = "/root/testdata/sf0.001"


def test_run_study_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="tessera-study-")
    res = run_study(td.upload_frame(spark, SF001), td.ORDER_SPEC, "order_key", folds=2,
                    model_names=("MLP", "RBF"), max_iter=15, bootstrap=20, out_dir=out)
    assert res.best_model in ("MLP", "RBF") and res.excluded_rows > 0
    comp = res.tables["model_comparison"].collect()
    assert len(comp) == 2 and sorted(r["rank"] for r in comp) == [1, 2]
    assert res.tables["cv_results"].count() == 4
    fr = res.tables["friedman"].collect()[0]
    assert not fr.available  # two treatments, two blocks
    assert res.tables["mcnemar"].count() == 1
    back = spark.read.parquet(f"{out}/tables/model_comparison")
    assert back.count() == 2


def test_a_report_evaluates_predictions_once(spark, monkeypatch):
    from tessera.operators import metrics
    from tessera.plans import queries as q
    made, measured = [], []
    predictions, measure = q.predictions, metrics.classification_metrics
    monkeypatch.setattr(q, "predictions", lambda *a: made.append(a) or predictions(*a))
    monkeypatch.setattr(metrics, "classification_metrics", lambda p, by, **k: measured.append(by) or measure(p, by, **k))
    rows = q.q_report_json_roundtrip(spark, SF001).collect()
    assert {r["report_table"] for r in rows} == set(q.REPORT_TABLES)
    assert len(made) == 1 and sorted(measured) == [["model"], ["model", "fold"]]

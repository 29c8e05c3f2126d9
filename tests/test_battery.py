from panelyard.operators import metrics as M
from panelyard.operators import splits as S
from panelyard.plans import fixtures as fx
from panelyard.plans import triage_queries as Q


def counted(monkeypatch, module, name):
    calls, inner = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or inner(*a, **k))
    return calls


def test_battery_reads_the_line_items_once(spark, sf_dir, monkeypatch):
    passes, curves = counted(monkeypatch, fx, "lines"), counted(monkeypatch, M, "curve")
    checks = {x["check"] for x in Q.battery(spark, sf_dir).collect()}
    assert checks == {"temporal_holdout", "rolling_mean", "rolling_worst", "unseen_places", "shuffled_control"}
    assert len(passes) == 1 and len(curves) == 4


def test_scores_from_one_curve(spark, monkeypatch):
    """Both scores of a group come from one curve and equal those on their own; groups without scores or with one class keep their rows."""
    rows = [("a", 0.1, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.8, 1), ("b", 0.3, 1), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    ap = {x.g: x.ap for x in M.average_precision(df, ["g"]).collect()}
    auc = {x.g: x.roc_auc for x in M.roc_auc(df, ["g"]).collect()}
    curves = counted(monkeypatch, M, "curve")
    got = {x.g: (x.n, x.positives, x.ap, x.roc_auc) for x in S.scores_by(df, ["g"]).collect()}
    assert len(curves) == 1
    assert got == {"a": (4, 2, ap["a"], auc["a"]), "b": (1, 1, 1.0, None), "c": (1, 1, None, None)}
    assert abs(ap["a"] - 5 / 6) < 1e-12 and auc["a"] == 0.875

"""Paired tests against the study's published fold scores and results (values copied as literals)."""

import numpy as np
import math
import pytest

from tessera.functions import dist
from tessera.operators import stats

# Fold F1 of the five models (model, fold, f1), and the published results.
CV = [('MLP', 1, 0.9979919678714859), ('MLP', 2, 0.9994982438534872), ('MLP', 3, 0.997491219267436),
      ('MLP', 4, 0.9994982438534872), ('MLP', 5, 0.9989969909729187), ('DNN', 1, 0.9919517102615694),
      ('DNN', 2, 0.9934640522875817), ('DNN', 3, 0.9914786967418546), ('DNN', 4, 0.9893670886075949),
      ('DNN', 5, 0.9821519632840388), ('RBF', 1, 0.9608938547486033), ('RBF', 2, 0.9630738522954092),
      ('RBF', 3, 0.9684638860630722), ('RBF', 4, 0.9712846347607053), ('RBF', 5, 0.9649211997966446),
      ('CNN_MLP', 1, 0.9506416584402764), ('CNN_MLP', 2, 0.9437102300538424), ('CNN_MLP', 3, 0.9635108481262328),
      ('CNN_MLP', 4, 0.9536945812807882), ('CNN_MLP', 5, 0.954228855721393), ('LSTM_MLP', 1, 0.919260700389105),
      ('LSTM_MLP', 2, 0.9352941176470588), ('LSTM_MLP', 3, 0.9436052366565961),
      ('LSTM_MLP', 4, 0.9397828232971372), ('LSTM_MLP', 5, 0.9462151394422311)]
T_EXPECTED = {  # (a, b): t, p, p_holm, ci_low, ci_high
    ('CNN_MLP', 'DNN'): (-8.783579590358013, 0.0009264871587921003, 0.006485410111544702, -0.048070983146687445, -0.02497995187735521),
    ('CNN_MLP', 'LSTM_MLP'): (3.7604568892995607, 0.019767061423669054, 0.026312425818058746, 0.004271984493927754, 0.028379277982234018),
    ('CNN_MLP', 'MLP'): (-13.075372416296743, 0.00019750904604531812, 0.0017236442931089723, -0.05520772974965074, -0.03586846712886216),
    ('CNN_MLP', 'RBF'): (-4.78073546762518, 0.008770808606019581, 0.026312425818058746, -0.019870510687719202, -0.005269990929041535),
    ('DNN', 'LSTM_MLP'): (8.668461100233108, 0.000974545750343073, 0.006485410111544702, 0.03592327583755543, 0.06977892166264898),
    ('DNN', 'MLP'): (-4.265111832287841, 0.013000588420220626, 0.026312425818058746, -0.014879552125747663, -0.0031457097287225797),
    ('DNN', 'RBF'): (8.158032551789994, 0.001228886877069979, 0.006485410111544702, 0.015802473534433696, 0.03210795987284822),
    ('LSTM_MLP', 'MLP'): (-13.17844177446335, 0.0001915160325676636, 0.0017236442931089723, -0.07489723184636878, -0.04883022750830589),
    ('LSTM_MLP', 'RBF'): (-7.583117890844848, 0.0016218692872785134, 0.006487477149114054, -0.03947567671972221, -0.0183160873732003),
    ('MLP', 'RBF'): (17.831563592305123, 5.8122229705979495e-05, 0.0005812222970597949, 0.027834623126483653, 0.03810107213526851),
}


@pytest.fixture(scope="module")
def cv(spark):
    df = spark.createDataFrame(CV, "model string, fold int, f1 double")
    comp = stats.complete_blocks(df, [], "fold", "model", "f1")
    return comp, stats.paired_differences(comp, [], "fold", "model", "f1")


def close(a, b, rel=1e-9):
    return abs(a - b) <= rel * max(1e-300, abs(b))


def test_friedman(cv):
    comp, _ = cv
    r = stats.friedman(comp, [], "fold", "model", "f1").collect()[0]
    assert r.available and r.df == 4 and r.n == 5 and r.k == 5
    assert close(r.statistic, 20.0) and close(r.p_value, 0.0004993992273873336)
    assert close(r.kendall_w, 1.0) and r.significant


def test_paired_t_and_holm(cv):
    _, d = cv
    rows = {(r.model_a, r.model_b): r for r in stats.paired_t(d, []).collect()}
    assert set(rows) == set(T_EXPECTED)
    for pair, (t, p, ph, lo, hi) in T_EXPECTED.items():
        r = rows[pair]
        assert close(r.t_statistic, t) and close(r.p_value, p) and close(r.p_value_holm, ph)
        assert close(r.ci95_low, lo) and close(r.ci95_high, hi)
        assert r.ci95_low <= r.mean_difference <= r.ci95_high
        assert r.degrees_of_freedom == 4


def test_wilcoxon_exact(cv):
    _, d = cv
    rows = stats.wilcoxon(d, []).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.method == "exact" and r.statistic == 0.0 and r.n_nonzero == 5
        assert close(r.p_value, 0.0625) and close(r.p_value_holm, 0.625) and not r.significant
        assert abs(r.effect) == 1.0


@pytest.mark.parametrize("b,c,p", [(32, 0, 4.2513944082491124e-08), (98, 0, 1.1429287839034977e-22),
                                   (119, 0, 2.8585386850375234e-27), (136, 0, 5.443350609192972e-31)])
def test_mcnemar_published_tables(spark, b, c, p):
    # rebuild predictions that produce the published 2x2 table (both right 3000, both wrong 3)
    rows, k = [], 0
    for best_ok, comp_ok, count in [(1, 1, 3000), (1, 0, b), (0, 1, c), (0, 0, 3)]:
        for _ in range(count):
            rows.append((k, "BEST", 1, 0.9 if best_ok else 0.1))
            rows.append((k, "OTHER", 1, 0.9 if comp_ok else 0.1))
            k += 1
    df = spark.createDataFrame(rows, "key long, model string, y int, score double")
    r = stats.mcnemar(df, "BEST", "key").collect()[0]
    assert r.best_only_correct == b and r.competitor_only_correct == c
    assert close(r.p_value, p, 1e-9)


def test_reference_unit_case(spark):
    # three models x five folds (the study's own unit test)
    scores = {"MLP": [0.80, 0.82, 0.81, 0.83, 0.84], "DNN": [0.779, 0.792, 0.797, 0.813, 0.819],
              "RBF": [0.743, 0.761, 0.752, 0.771, 0.779]}
    df = spark.createDataFrame([(m, i + 1, v) for m, vs in scores.items() for i, v in enumerate(vs)],
                               "model string, fold int, f1 double")
    comp = stats.complete_blocks(df, [], "fold", "model", "f1")
    fr = stats.friedman(comp, [], "fold", "model", "f1").collect()[0]
    assert fr.p_value < 0.05 and fr.df == 2 and fr.kendall_w > 0
    d = stats.paired_differences(comp, [], "fold", "model", "f1")
    t = stats.paired_t(d, []).collect()
    w = stats.wilcoxon(d, []).collect()
    assert len(t) == 3 and len(w) == 3
    assert all(0 <= r.p_value_holm <= 1 for r in w)
    assert all(r.ci95_low <= r.mean_difference <= r.ci95_high for r in t)
    assert all(r.interpretation for r in t + w)


def test_edge_cases(spark):
    # identical treatments (sd 0, all zero differences), fewer than 3 blocks, a constant shift
    rows = [("A", 1, 0.5), ("B", 1, 0.5), ("C", 1, 0.75), ("A", 2, 0.25), ("B", 2, 0.25), ("C", 2, 0.5)]
    df = spark.createDataFrame(rows, "model string, fold int, f1 double")
    comp = stats.complete_blocks(df, [], "fold", "model", "f1")
    fr = stats.friedman(comp, [], "fold", "model", "f1").collect()[0]
    assert not fr.available and fr.p_value is None and fr.reason
    d = stats.paired_differences(comp, [], "fold", "model", "f1")
    t = {(r.model_a, r.model_b): r for r in stats.paired_t(d, []).collect()}
    assert t[("A", "B")].t_statistic == 0.0 and t[("A", "B")].p_value == 1.0
    assert t[("A", "B")].direction == "is equal" and t[("A", "B")].cohen_d_paired == 0.0
    ac = t[("A", "C")]
    assert ac.t_statistic == float("-inf") and ac.p_value == 0.0 and ac.ci95_low == ac.mean_difference
    w = {(r.model_a, r.model_b): r for r in stats.wilcoxon(d, []).collect()}
    assert w[("A", "B")].statistic == 0.0 and w[("A", "B")].p_value == 1.0 and w[("A", "B")].effect == 0.0


def test_far_tails_of_student_t_keep_their_digits(spark):
    """Against Gauss-Legendre quadrature of the density over the angle, which loses nothing to cancellation."""
    nodes, weights = np.polynomial.legendre.leggauss(400)

    def tail(t, n):
        low = math.atan(t / math.sqrt(n))
        x = (nodes + 1) / 2
        part = lambda a: ((math.pi / 2 - a) / 2 * weights * np.cos(a + (math.pi / 2 - a) * x) ** (n - 1)).sum()
        return part(low) / part(0.0)

    cases = [(12.0, 79), (40.0, 79), (3.0, 1), (0.1, 2), (25.0, 4), (1.5, 30), (8.0, 200), (2.0, 1001), (0.0, 5)]
    df = spark.createDataFrame(cases, "t double, n int").selectExpr("t", "n", f"{dist.t_sf2('t', 'n')} AS p")
    for r in df.collect():
        assert abs(r["p"] / tail(r["t"], r["n"]) - 1) < 1e-9, tuple(r)
    # published two-sided 5 % points
    points = {1: 12.7062, 2: 4.30265, 10: 2.22814, 79: 1.99045, 100_001: 1.95999}
    df = spark.createDataFrame([(n,) for n in points], "n int").selectExpr("n", f"{dist.t_quantile2('0.05D', 'n')} AS q")
    assert all(abs(r["q"] - points[r["n"]]) < 1e-4 for r in df.collect())


def test_chi_square_of_odd_degrees(spark):
    # published 5 % points
    df = spark.createDataFrame([(3.841459, 1), (7.814728, 3), (11.070498, 5), (16.918978, 9)], "x double, k int").selectExpr(f"{dist.chi2_sf('x', 'k')} AS p")
    assert all(abs(r["p"] - 0.05) < 1e-7 for r in df.collect())

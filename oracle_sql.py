"""ANSI-SQL (DuckDB dialect) oracles for the registered queries.

Independent re-statements of each query over the same parquet views; the
check tool runs them next to the Spark queries and compares results.
"""

from __future__ import annotations

from tessera.sources.testdata import MESSY_RESULT, MODEL_SIGNAL, MODELS, UPLOAD_COLUMNS

R = 9


def _upload(messy: bool = False) -> str:
    cols = list(UPLOAD_COLUMNS)
    if messy:
        cols[-1] = (MESSY_RESULT, "Result")
    select = ",\n    ".join(f'{sql} AS "{name}"' for sql, name in cols)
    return f"SELECT\n    {select}\nFROM orders LEFT JOIN customer ON o_custkey = c_custkey"


TARGET = """CASE lower(trim("Result"))
      WHEN 'yes' THEN 1.0 WHEN 'true' THEN 1.0 WHEN 'si' THEN 1.0 WHEN 'sí' THEN 1.0
      WHEN 'required' THEN 1.0 WHEN '1' THEN 1.0
      WHEN 'no' THEN 0.0 WHEN 'false' THEN 0.0 WHEN '0' THEN 0.0 WHEN 'not_required' THEN 0.0
      ELSE CASE WHEN isnan(TRY_CAST(lower(trim("Result")) AS DOUBLE)) THEN NULL
                ELSE TRY_CAST(lower(trim("Result")) AS DOUBLE) END END"""


def _coerced(messy: bool = False) -> str:
    return f"""SELECT "Order Key" AS order_key,
    CAST("Total Price" AS DOUBLE) AS total_price,
    CAST("Acct Bal" AS DOUBLE) AS account_balance,
    TRY_CAST("Order Month" AS DOUBLE) AS order_month,
    CAST("Order Status" AS VARCHAR) AS order_status,
    CAST("Order-Priority" AS VARCHAR) AS order_priority,
    CAST("Mkt Segment" AS VARCHAR) AS market_segment,
    "Order Month" AS raw_month,
    {TARGET} AS result_value
  FROM ({_upload(messy)})"""


OBS = f"""obs AS (
  SELECT order_key, total_price, account_balance, order_month, order_status, order_priority,
         market_segment, CAST(result_value AS INTEGER) AS result
  FROM ({_coerced()}) WHERE result_value IN (0, 1))"""


def _u(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def score_sql(key: str, y: str, model: str, seed: int = 42) -> str:
    w = MODEL_SIGNAL[model]
    return f"(CAST({w} AS DOUBLE) * {y} + CAST({1 - w} AS DOUBLE) * {_u(f'concat(CAST({key} AS VARCHAR), {chr(39)}{model}{chr(39)}, {chr(39)}{seed}{chr(39)})')})"


def _scores_union(src: str, key: str, y: str) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT {key}, {y}, '{m}' AS model, {score_sql(key, y, m)} AS score FROM {src}" for m in MODELS)


def _slice1() -> dict[str, str]:
    q = {}
    q["normalize_upload"] = f"""SELECT "Order Key" AS order_key, "Total Price" AS total_price,
  "Acct Bal" AS account_balance, "Order Month" AS order_month, "Order Status" AS order_status,
  "Order-Priority" AS order_priority, "Mkt Segment" AS market_segment, "Result" AS result
FROM ({_upload()})"""
    q["coerce"] = f"""SELECT order_key, total_price, account_balance, order_month, order_status, order_priority,
  market_segment, result_value FROM ({_coerced()})"""
    q["validation_counters"] = f"""SELECT count(*) AS rows_in,
  count_if(CAST(total_price AS VARCHAR) IS NOT NULL AND TRY_CAST(CAST(total_price AS VARCHAR) AS DOUBLE) IS NULL) AS non_numeric_total_price,
  count_if(CAST(account_balance AS VARCHAR) IS NOT NULL AND TRY_CAST(CAST(account_balance AS VARCHAR) AS DOUBLE) IS NULL) AS non_numeric_account_balance,
  count_if(raw_month IS NOT NULL AND order_month IS NULL) AS non_numeric_order_month,
  count_if(result_value IS NOT DISTINCT FROM 2.0) AS rows_excluded,
  count_if(result_value IS DISTINCT FROM 2.0 AND (result_value IS NULL OR result_value NOT IN (0, 1))) AS rows_invalid,
  count(DISTINCT CASE WHEN result_value IN (0, 1) THEN result_value END) AS n_classes
FROM ({_coerced()})"""
    q["clean"] = f"WITH {OBS} SELECT * FROM obs"
    q["quarantine"] = f"""SELECT order_key, result_value FROM ({_coerced(messy=True)})
WHERE result_value IS DISTINCT FROM 2.0 AND (result_value IS NULL OR result_value NOT IN (0, 1))"""
    q["range_rules"] = f"""WITH {OBS}
SELECT order_key,
  concat_ws(',', CASE WHEN total_price <= 0 THEN 'price_not_positive' END,
                 CASE WHEN account_balance < 0 THEN 'balance_negative' END,
                 CASE WHEN order_month < 1 OR order_month > 12 THEN 'month_out_of_range' END,
                 CASE WHEN account_balance IS NULL THEN 'account_balance_missing' END,
                 CASE WHEN market_segment IS NULL THEN 'market_segment_missing' END) AS violations,
  NOT (coalesce(total_price <= 0, false) OR coalesce(account_balance < 0, false)
       OR coalesce(order_month < 1 OR order_month > 12, false)
       OR account_balance IS NULL OR market_segment IS NULL) AS passes
FROM obs"""
    s = score_sql("order_key", "result", "scorer_a")
    q["threshold_class"] = f"""WITH {OBS}
SELECT order_key, round({s}, {R}) AS score, CAST({s} >= 0.5 AS INTEGER) AS predicted_class,
  CASE WHEN {s} >= 0.5 THEN 'Irrigation required' ELSE 'No irrigation required' END AS recommendation
FROM obs"""
    q["counts"] = f"WITH {OBS} SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns FROM obs"
    q["duplicates"] = """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_rows
FROM (SELECT event_type, floor(value) AS value_floor, count(*) AS n FROM events GROUP BY ALL)"""
    cols = ["order_key", "total_price", "account_balance", "order_month", "order_status", "order_priority",
            "market_segment", "result_value"]
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL"
        + (f" OR isnan({c})" if c in ("total_price", "account_balance", "order_month", "result_value") else "")
        + f") AS missing FROM c" for c in cols)
    q["missing"] = f"WITH c AS ({_coerced()}) {unions}"
    q["class_distribution"] = f"WITH {OBS} SELECT result AS class, count(*) AS rows FROM obs GROUP BY result"
    lcols = ["l_quantity", "l_extendedprice", "l_discount"]
    q["describe_lineitem"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem""" for c in lcols)
    ccols = ["order_status", "order_priority", "market_segment"]
    q["describe_categorical"] = f"""WITH {OBS},
long AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM obs WHERE {c} IS NOT NULL" for c in ccols)}),
pv AS (SELECT "column", value, count(*) AS n FROM long GROUP BY ALL)
SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM pv GROUP BY 1"""
    ncols = ["total_price", "account_balance", "order_month"]
    long_num = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM obs WHERE {c} IS NOT NULL" for c in ncols)
    q["histogram"] = f"""WITH {OBS}, long AS ({long_num}),
rng AS (SELECT "column", CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
               CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
        FROM long GROUP BY "column"),
b AS (SELECT l."column", CAST(least(floor((value - lo) / ((hi - lo) / 24)), 23) AS INTEGER) AS bin, count(*) AS n
      FROM long l JOIN rng USING ("column") GROUP BY ALL),
grid AS (SELECT "column", lo, hi, CAST(g.bin AS INTEGER) AS bin FROM rng, range(0, 24) g(bin))
SELECT grid."column", grid.bin, round(lo + grid.bin * (hi - lo) / 24, 6) AS lower,
       round(lo + (grid.bin + 1) * (hi - lo) / 24, 6) AS upper, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM grid LEFT JOIN b ON grid."column" = b."column" AND grid.bin = b.bin"""
    q["box_stats"] = f"""WITH {OBS}, long AS ({long_num}),
qs AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM long GROUP BY "column")
SELECT "column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_low,
  max(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
  count_if(NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM long JOIN qs USING ("column") GROUP BY "column", q1, median, q3"""
    ccols4 = ["total_price", "account_balance", "order_month", "result"]
    parts = []
    for i, a in enumerate(ccols4):
        parts.append(f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r")
        for b in ccols4[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), {R}) AS r FROM obs")
            parts.append(f"SELECT '{b}' AS a, '{a}' AS b, round(corr({a}, {b}), {R}) AS r FROM obs")
    q["correlation"] = f"WITH {OBS} " + " UNION ALL ".join(parts)
    q["category_class"] = f"""WITH {OBS} {" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS category, result AS class, count(*) AS rows FROM obs GROUP BY ALL"
        for c in ccols)}"""
    q["class_weights"] = f"""WITH c AS (SELECT quality AS class, count(*) AS rows FROM labels GROUP BY quality),
t AS (SELECT sum(rows) AS total, count(*) AS k, max(rows) * 1.0 / min(rows) AS ratio FROM c)
SELECT class, rows, round(CASE WHEN ratio >= 1.5 AND k >= 2 THEN total / (2.0 * rows) ELSE 1.0 END, {R}) AS weight
FROM c, t"""
    return q


def _hash_order(key: str, salt: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(concat(CAST({key} AS VARCHAR), '|{salt}|{seed}')), 1, 15)) AS BIGINT)"


def _split_ctes(src: str, name: str, salt: str = "split", frac: float = 0.2, folds: int = 5) -> str:
    """CTEs ending in ``name``: src rows + is_test + fold (exact quotas, md5 rank)."""
    return f"""{name}_cnt AS (SELECT result, count(*) AS n_c FROM {src} GROUP BY result),
{name}_q0 AS (SELECT result, n_c, sum(n_c) OVER () AS nn,
              sum(n_c) OVER () - ceil({frac} * sum(n_c) OVER ()) AS n_train FROM {name}_cnt),
{name}_q1 AS (SELECT *, n_c / nn * n_train AS cont, floor(n_c / nn * n_train) AS fl FROM {name}_q0),
{name}_q2 AS (SELECT *, n_train - sum(fl) OVER () AS lft, cont - fl AS rem FROM {name}_q1),
{name}_q3 AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, result) <= lft THEN 1 ELSE 0 END
                     AS train_c FROM {name}_q2),
{name}_cls AS (SELECT result, n_c - train_c AS test_c,
               coalesce(sum(train_c) OVER (ORDER BY result ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS offset_c FROM {name}_q3),
{name}_rk AS (SELECT s.*, row_number() OVER (PARTITION BY result ORDER BY {_hash_order('order_key', salt)}, order_key)
              AS rk FROM {src} s),
{name} AS (SELECT r.* EXCLUDE (rk), rk <= test_c AS is_test,
           CASE WHEN rk > test_c THEN CAST(((offset_c + rk - test_c - 1) % {folds}) + 1 AS INTEGER) END AS fold
           FROM {name}_rk r JOIN {name}_cls USING (result))"""


SPLIT = f"{OBS},\n{_split_ctes('obs', 'split')}"
NUM = ["total_price", "account_balance", "order_month"]
CAT_LEVELS = {
    "order_status": ["F", "O", "P"],
    "order_priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "market_segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


def _slice2() -> dict[str, str]:
    q = {}
    q["holdout_split"] = f"WITH {SPLIT} SELECT order_key, result, is_test FROM split"
    q["kfold_assign"] = f"WITH {SPLIT} SELECT order_key, result, fold FROM split WHERE NOT is_test"
    q["fold_sizes"] = f"WITH {SPLIT} SELECT is_test, fold, result, count(*) AS rows FROM split GROUP BY ALL"
    q["inner_split"] = f"""WITH {SPLIT},
train AS (SELECT * EXCLUDE (is_test, fold) FROM split WHERE NOT is_test),
{_split_ctes('train', 'inn', salt='tune', folds=2)}
SELECT order_key, result, is_test AS is_validation FROM inn"""
    q["head_sample"] = f"WITH {OBS} SELECT * FROM obs ORDER BY order_key LIMIT 1000"
    med = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in NUM)
    mom = ", ".join(f"avg(coalesce({c}, med_{c})) AS mean_{c}, stddev_pop(coalesce({c}, med_{c})) AS sd_{c}"
                    for c in NUM)
    modes = ",\n".join(
        f"mode_{c} AS (SELECT arg_min({c}, (-n, {c})) AS v FROM "
        f"(SELECT {c}, count(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY {c}))" for c in CAT_LEVELS)
    scaled = ", ".join(
        f"round((coalesce({c}, med_{c}) - mean_{c}) / CASE WHEN sd_{c} < 10 * 2.220446049250313e-16 THEN 1.0 "
        f"ELSE sd_{c} END, {R}) AS {c}" for c in NUM)
    onehot = ", ".join(
        f"CAST(coalesce({c}, mode_{c}.v) = '{lv}' AS DOUBLE) AS \"{c}={lv}\""
        for c, lvs in CAT_LEVELS.items() for lv in lvs)
    q["preprocess_apply"] = f"""WITH {SPLIT},
train AS (SELECT * FROM split WHERE NOT is_test),
med AS (SELECT {med} FROM train),
mom AS (SELECT {mom} FROM train, med),
{modes}
SELECT order_key, {scaled}, {onehot}
FROM split, med, mom, {", ".join(f"mode_{c}" for c in CAT_LEVELS)}
WHERE is_test"""
    long_num = " UNION ALL ".join(f"SELECT f.f AS fold, '{c}' AS \"column\", {c} AS value FROM train t, "
                                  f"range(1, 6) f(f) WHERE t.fold <> f.f" for c in NUM)
    q["fold_numeric_stats"] = f"""WITH {SPLIT},
train AS (SELECT * FROM split WHERE NOT is_test),
long AS ({long_num}),
med AS (SELECT fold, "column", quantile_cont(value, 0.5) AS median FROM long GROUP BY ALL),
st AS (SELECT l.fold, l."column", m.median, avg(coalesce(value, m.median)) AS mean,
              stddev_pop(coalesce(value, m.median)) AS s
       FROM long l JOIN med m ON l.fold = m.fold AND l."column" = m."column" GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold, "column", round(median, 6) AS median, round(mean, 6) AS mean,
       round(CASE WHEN s IS NULL OR s < 10 * 2.220446049250313e-16 THEN 1.0 ELSE s END, 6) AS scale FROM st"""
    long_cat = " UNION ALL ".join(f"SELECT f.f AS fold, '{c}' AS \"column\", {c} AS value FROM train t, "
                                  f"range(1, 6) f(f) WHERE t.fold <> f.f AND {c} IS NOT NULL" for c in CAT_LEVELS)
    q["fold_category_stats"] = f"""WITH {SPLIT},
train AS (SELECT * FROM split WHERE NOT is_test),
long AS ({long_cat}),
cnt AS (SELECT fold, "column", value, count(*) AS n FROM long GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold, "column", arg_min(value, (-n, value)) AS mode, count(*) AS levels
FROM cnt GROUP BY ALL"""
    return q


PRED = f"""{SPLIT},
pred AS (SELECT s.order_key, s.result AS y, m.model, s.is_test, s.fold,
  CAST(CASE m.model {" ".join(f"WHEN '{mm}' THEN {MODEL_SIGNAL[mm]}" for mm in MODELS)} END AS DOUBLE) * s.result
  + CAST(CASE m.model {" ".join(f"WHEN '{mm}' THEN {1 - MODEL_SIGNAL[mm]}" for mm in MODELS)} END AS DOUBLE)
  * (CAST(('0x' || substr(md5(concat(CAST(s.order_key AS VARCHAR), m.model, '42')), 1, 8)) AS BIGINT) / 4294967296.0)
  AS score
  FROM split s, (VALUES {", ".join(f"('{mm}')" for mm in MODELS)}) m(model))"""


def _metrics_sql(where: str, by: str) -> str:
    eps = "2.220446049250313e-16"
    return f"""WITH {PRED},
p AS (SELECT * FROM pred WHERE {where}),
c AS (SELECT {by}, count_if(y = 0 AND score < 0.5) AS tn, count_if(y = 0 AND score >= 0.5) AS fp,
             count_if(y = 1 AND score < 0.5) AS fn, count_if(y = 1 AND score >= 0.5) AS tp, count(*) AS n,
             sum(CASE WHEN y = 1 THEN -ln(greatest(least(score, 1 - {eps}), {eps}))
                      ELSE -ln(greatest(least(1 - score, 1 - {eps}), {eps})) END) AS ll,
             sum((score - y) * (score - y)) AS se
      FROM p GROUP BY ALL),
lv AS (SELECT {by}, score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY ALL),
a AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg))
                  ELSE 0.0 END AS roc_auc
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM lv) GROUP BY ALL),
ap AS (SELECT {by}, CASE WHEN sum(pos) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tps / (tps + fps) ELSE 0 END) / sum(pos)
                   ELSE 0.0 END AS pr_auc
       FROM (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM lv
             WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       GROUP BY ALL),
m AS (SELECT c.*, CAST(tn AS DOUBLE) AS tnd, CAST(fp AS DOUBLE) AS fpd, CAST(fn AS DOUBLE) AS fnd,
             CAST(tp AS DOUBLE) AS tpd FROM c)
SELECT {", ".join("m." + b.strip() for b in by.split(","))},
  round(CASE WHEN n > 0 THEN (tpd + tnd) / n ELSE 0 END, 10) AS accuracy,
  round(CASE WHEN tpd + fpd > 0 THEN tpd / (tpd + fpd) ELSE 0 END, 10) AS precision,
  round(CASE WHEN tpd + fnd > 0 THEN tpd / (tpd + fnd) ELSE 0 END, 10) AS recall,
  round(CASE WHEN tnd + fpd > 0 THEN tnd / (tnd + fpd) ELSE 0 END, 10) AS specificity,
  round(CASE WHEN 2 * tpd + fpd + fnd > 0 THEN 2 * tpd / (2 * tpd + fpd + fnd) ELSE 0 END, 10) AS f1,
  round(roc_auc, 10) AS roc_auc, round(pr_auc, 10) AS pr_auc,
  round(CASE WHEN n > 0 THEN ll / n ELSE 0 END, 10) AS log_loss,
  round(CASE WHEN tpd + fnd > 0 AND tnd + fpd > 0 THEN (tpd / (tpd + fnd) + tnd / (tnd + fpd)) / 2
             WHEN tpd + fnd > 0 THEN tpd / (tpd + fnd) ELSE CASE WHEN tnd + fpd > 0 THEN tnd / (tnd + fpd) ELSE 0 END END,
        10) AS balanced_accuracy,
  round(CASE WHEN (tpd + fpd) * (tpd + fnd) * (tnd + fpd) * (tnd + fnd) > 0
             THEN (tpd * tnd - fpd * fnd) / sqrt((tpd + fpd) * (tpd + fnd) * (tnd + fpd) * (tnd + fnd)) ELSE 0 END, 10)
        AS mcc,
  round(CASE WHEN n > 0 THEN se / n ELSE 0 END, 10) AS brier_score, 0.5::DOUBLE AS threshold, n, tn, fp, fn, tp
FROM m JOIN a USING ({by}) JOIN ap USING ({by})"""


def _bootstrap_sql(metric: str, replicates: int = 200) -> str:
    u = ("(CAST(('0x' || substr(md5(concat(CAST(order_key AS VARCHAR), '|', CAST(b AS VARCHAR), '|42')), 1, 8))"
         " AS BIGINT) / 4294967296.0)")
    w = (f"list_reduce(range(1, 21), lambda acc, j: {{'p': acc.p / j, 'c': acc.c + acc.p / j, "
         f"'k': acc.k + CASE WHEN {u} > acc.c THEN 1 ELSE 0 END}}, "
         f"{{'p': 0.36787944117144233::DOUBLE, 'c': 0.36787944117144233::DOUBLE, 'k': 0}}).k")
    reps = f"""reps AS (SELECT model, b, y, score, CAST({w} AS DOUBLE) AS w
      FROM (SELECT * FROM pred WHERE is_test) p, range(1, {replicates + 1}) r(b)),
wr AS (SELECT * FROM reps WHERE w > 0)"""
    if metric == "f1":
        vals = """vals AS (SELECT model, b, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS v
      FROM (SELECT model, b, sum(CASE WHEN y = 1 AND score >= 0.5 THEN w ELSE 0 END) AS tp,
                   sum(CASE WHEN y = 0 AND score >= 0.5 THEN w ELSE 0 END) AS fp,
                   sum(CASE WHEN y = 1 AND score < 0.5 THEN w ELSE 0 END) AS fn FROM wr GROUP BY ALL))"""
    else:
        vals = """lv AS (SELECT model, b, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos,
                    sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM wr GROUP BY ALL),
vals AS (SELECT model, b, sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)) AS v
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, b ORDER BY score
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM lv)
      GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0)"""
    return f"""WITH {PRED}, {reps}, {vals}
SELECT model, round(quantile_cont(v, 0.025), 10) AS lower, round(quantile_cont(v, 0.975), 10) AS upper,
       count(*) AS replicates FROM vals GROUP BY model"""


def _slice3() -> dict[str, str]:
    q = {}
    q["cv_metrics"] = _metrics_sql("NOT is_test", "model, fold")
    q["test_metrics"] = _metrics_sql("is_test", "model")
    q["metric_heatmap"] = (f"SELECT model, accuracy, precision, recall, f1, roc_auc, balanced_accuracy FROM ("
                           f"{_metrics_sql('is_test', 'model')})")
    q["roc_curve"] = f"""WITH {PRED},
p AS (SELECT * FROM pred WHERE is_test),
lv AS (SELECT model, score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, row_number() OVER w AS idx,
             sum(pos) OVER (PARTITION BY model) AS pp, sum(neg) OVER (PARTITION BY model) AS nn,
             count(*) OVER (PARTITION BY model) AS m,
             lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg
      FROM lv WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, score AS threshold, round(fps / nn, 12) AS fpr, round(tps / pp, 12) AS tpr FROM r
WHERE idx = 1 OR idx = m OR m <= 2 OR npos <> pos OR nneg <> neg
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM p"""
    q["bootstrap_f1"] = _bootstrap_sql("f1")
    q["bootstrap_auc"] = _bootstrap_sql("roc_auc")
    q["bootstrap_auc_1000"] = _bootstrap_sql("roc_auc", 1000)
    return q


# ---------------------------------------------------------------------------
# distribution functions in DuckDB lambda syntax (same recipes, independent text)
# ---------------------------------------------------------------------------
_n = [0]


def _v() -> str:
    _n[0] += 1
    return f"v{_n[0]}"


def d_erfc(z: str) -> str:
    a, k, b, j = _v(), _v(), _v(), _v()
    zz = f"CAST(({z}) AS DOUBLE)"
    series = (f"(1.0 - 2.0 / sqrt(pi()) * list_reduce(range(0, 81), lambda {a}, {k}: "
              f"{{'t': -{a}.t * {zz} * {zz} / ({k} + 1), 's': {a}.s + {a}.t / (2 * {k} + 1)}}, "
              f"{{'t': {zz}, 's': 0.0::DOUBLE}}).s)")
    frac = (f"(exp(-{zz} * {zz}) / sqrt(pi()) / list_reduce(range(200, 0, -1), lambda {b}, {j}: "
            f"{zz} + ({j} / 2.0) / {b}, {zz}))")
    return f"(CASE WHEN {zz} IS NULL THEN NULL WHEN {zz} < 2.5 THEN {series} ELSE {frac} END)"


def _d_t_tail(theta: str, n: str) -> str:
    e, i, o, m = _v(), _v(), _v(), _v()
    c2 = f"pow(cos({theta}), 2)"
    even = (f"list_reduce(range(1, ({n}) // 2), lambda {e}, {i}: {{'t': {e}.t * (2 * {i} - 1) / (2 * {i}) * {c2}, "
            f"'s': {e}.s + {e}.t * (2 * {i} - 1) / (2 * {i}) * {c2}}}, {{'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}}).s")
    odd = (f"list_reduce(range(1, (({n}) - 1) // 2), lambda {o}, {m}: {{'t': {o}.t * (2 * {m}) / (2 * {m} + 1) * {c2}, "
           f"'s': {o}.s + {o}.t * (2 * {m}) / (2 * {m} + 1) * {c2}}}, {{'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}}).s")
    return (f"(1.0 - CASE WHEN ({n}) % 2 = 0 THEN sin({theta}) * {even} "
            f"ELSE 2.0 / pi() * ({theta} + CASE WHEN ({n}) > 1 THEN sin({theta}) * cos({theta}) * {odd} ELSE 0.0 END) END)")


def d_t_sf2(t: str, n: str) -> str:
    theta = f"atan(abs(CAST(({t}) AS DOUBLE)) / sqrt(CAST(({n}) AS DOUBLE)))"
    return f"(CASE WHEN ({t}) IS NULL OR ({n}) IS NULL OR ({n}) < 1 THEN NULL ELSE greatest(0.0, {_d_t_tail(theta, n)}) END)"


def d_t_quantile2(alpha: str, n: str, steps: int = 64) -> str:
    q, r = _v(), _v()
    mid = f"(({q}.lo + {q}.hi) / 2.0)"
    return (f"(sqrt(CAST(({n}) AS DOUBLE)) * tan(list_reduce(range(1, {steps + 1}), lambda {q}, {r}: "
            f"CASE WHEN {_d_t_tail(mid, n)} > ({alpha}) THEN {{'lo': {mid}, 'hi': {q}.hi}} "
            f"ELSE {{'lo': {q}.lo, 'hi': {mid}}} END, {{'lo': 0.0::DOUBLE, 'hi': pi() / 2.0}}) "
            f".lo / 2.0 + list_reduce(range(1, {steps + 1}), lambda {q}, {r}: "
            f"CASE WHEN {_d_t_tail(mid, n)} > ({alpha}) THEN {{'lo': {mid}, 'hi': {q}.hi}} "
            f"ELSE {{'lo': {q}.lo, 'hi': {mid}}} END, {{'lo': 0.0::DOUBLE, 'hi': pi() / 2.0}}).hi / 2.0))")


def d_chi2_sf(x: str, df: str) -> str:
    c, j, d, k = _v(), _v(), _v(), _v()
    xx = f"CAST(({x}) AS DOUBLE)"
    even = (f"exp(-{xx} / 2.0) * list_reduce(range(1, ({df}) // 2), lambda {c}, {j}: "
            f"{{'t': {c}.t * ({xx} / 2.0) / {j}, 's': {c}.s + {c}.t * ({xx} / 2.0) / {j}}}, "
            f"{{'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}}).s")
    odd_tail = (f"exp(-{xx} / 2.0) * list_reduce(range(1, (({df}) - 1) // 2 + 1), lambda {d}, {k}: "
                f"{{'t': {d}.t * ({xx} / 2.0) / ({k} + 0.5), 's': {d}.s + {d}.t}}, "
                f"{{'t': sqrt({xx} / 2.0) / (sqrt(pi()) / 2.0), 's': 0.0::DOUBLE}}).s")
    return (f"(CASE WHEN {xx} IS NULL OR ({df}) IS NULL THEN NULL WHEN {xx} <= 0 THEN 1.0 "
            f"WHEN ({df}) % 2 = 0 THEN {even} ELSE ({d_erfc(f'sqrt({xx} / 2.0)')} + {odd_tail}) END)")


def d_signed_rank_exact(w: str, n: str) -> str:
    a, r, i, x = _v(), _v(), _v(), _v()
    counts = (f"list_reduce(range(1, ({n}) + 1), lambda {a}, {r}: list_transform(range(0, len({a})), lambda {i}: "
              f"{a}[{i} + 1] + CASE WHEN {i} >= {r} THEN {a}[{i} - {r} + 1] ELSE 0 END), "
              f"list_concat([1::BIGINT], list_transform(range(0, ({n}) * (({n}) + 1) // 2), lambda {x}: 0::BIGINT)))")
    return f"least(1.0, 2.0 * list_sum(({counts})[1:CAST(floor({w}) AS BIGINT) + 1]) / pow(2.0, ({n})))"


def d_signed_rank_normal(w: str, n: str, tie: str) -> str:
    nn = f"CAST(({n}) AS DOUBLE)"
    z = f"((({w}) - {nn} * ({nn} + 1.0) / 4.0) / sqrt(({nn} * ({nn} + 1.0) * (2.0 * {nn} + 1.0) - 0.5 * ({tie})) / 24.0))"
    return d_erfc(f"abs({z}) / sqrt(2.0)")


def _fold_scores(by_status: bool = False) -> str:
    fam = "o_orderstatus AS family, " if by_status else ""
    return (f"SELECT {fam}strftime(o_orderdate, '%Y-%m') AS block, o_orderpriority AS treatment, "
            f"avg(o_totalprice) AS value FROM orders GROUP BY ALL")


def _complete(src: str, fam: list[str], block: str, treat: str, value: str) -> str:
    f = ", ".join(fam) + ", " if fam else ""
    on = " AND ".join([f"c.{x} IS NOT DISTINCT FROM kk.{x}" for x in fam]) or "TRUE"
    return f"""(SELECT c.* FROM (SELECT {f}{block}, {treat}, avg({value}) AS {value} FROM ({src}) GROUP BY ALL
        HAVING avg({value}) IS NOT NULL) c
      JOIN (SELECT {f}count(DISTINCT {treat}) AS k FROM (SELECT {f}{treat}, avg({value}) AS v FROM ({src})
            GROUP BY ALL HAVING avg({value}) IS NOT NULL) GROUP BY ALL) kk ON {on}
      JOIN (SELECT {f}{block}, count(*) AS m FROM (SELECT {f}{block}, {treat} FROM ({src}) GROUP BY ALL
            HAVING avg({value}) IS NOT NULL) GROUP BY ALL) mm
        ON {" AND ".join([f"c.{x} IS NOT DISTINCT FROM mm.{x}" for x in fam] + [f"c.{block} = mm.{block}"])}
      WHERE mm.m = kk.k)"""


def _friedman_sql(comp: str, fam: list[str], block: str, treat: str, value: str) -> str:
    f = ", ".join(fam) + ", " if fam else ""
    pf = f"PARTITION BY {', '.join(fam + [block])}"
    g = ", ".join(fam)
    gb = f"GROUP BY {g}" if fam else ""
    stat = "CASE WHEN k >= 3 AND n >= 3 AND corr > 0 THEN qraw / corr END"
    return f"""WITH comp AS {comp},
rk AS (SELECT *, rank() OVER ({pf} ORDER BY {value}) + (count(*) OVER ({pf}, {value}) - 1) / 2.0 AS r FROM comp),
pt AS (SELECT {f}{treat}, sum(r) AS rr FROM rk GROUP BY ALL),
ss AS (SELECT {f}sum(rr * rr) AS ss, count(*) AS k FROM pt {gb}),
nb AS (SELECT {f}count(DISTINCT {block}) AS n FROM comp {gb}),
ti AS (SELECT {f}sum(pow(t, 3) - t) AS tie FROM (SELECT {f}{block}, {value}, count(*) AS t FROM comp GROUP BY ALL)
       {gb}),
al AS (SELECT * FROM ss {"NATURAL JOIN nb NATURAL JOIN ti" if fam else ", nb, ti"}),
st AS (SELECT *, 1.0 - tie / (CAST(n AS DOUBLE) * k * (CAST(k AS DOUBLE) * k - 1.0)) AS corr,
              (12.0 / (CAST(n AS DOUBLE) * k * (k + 1.0))) * ss - 3.0 * n * (k + 1.0) AS qraw FROM al),
fin AS (SELECT {f}k, n, {stat} AS statistic, CAST(k - 1 AS INTEGER) AS df, (k >= 3 AND n >= 3) AS available FROM st)
SELECT {f}k, n, round(statistic, 6) AS statistic, df, available,
  round(CASE WHEN available THEN {d_chi2_sf('statistic', 'df')} END, 10) AS p_value,
  round(CASE WHEN available THEN statistic / (n * (k - 1)) END, 9) AS kendall_w,
  coalesce(CASE WHEN available THEN {d_chi2_sf('statistic', 'df')} END < 0.05, false) AS significant,
  CASE WHEN NOT available THEN 'Friedman needs at least 3 treatments and 3 complete blocks.' END AS reason
FROM fin"""


def _pairs(comp: str, fam: list[str], block: str, treat: str, value: str) -> str:
    on = " AND ".join([f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in fam] + [f"a.{block} = b.{block}",
                                                                           f"a.{treat} < b.{treat}"])
    f = "".join(f"a.{x}, " for x in fam)
    return (f"(SELECT {f}a.{block}, a.{treat} AS model_a, b.{treat} AS model_b, a.{value} - b.{value} AS d "
            f"FROM {comp} a JOIN {comp} b ON {on})")


def _holm_sql(src: str, fam: list[str], p: str, out: str) -> str:
    part = ", ".join(fam + ["valid"])
    return f"""(SELECT *, CASE WHEN valid THEN least(1.0, max(h) OVER (PARTITION BY {part} ORDER BY {p}, model_a, model_b
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {out}
  FROM (SELECT *, (count(*) OVER (PARTITION BY {part}) - row_number() OVER (PARTITION BY {part} ORDER BY {p}, model_a, model_b)
                   + 1) * {p} AS h
        FROM (SELECT *, {p} IS NOT NULL AND NOT isnan({p}) AND NOT isinf({p}) AS valid FROM {src})))"""


def _paired_t_sql(diffs: str, fam: list[str]) -> str:
    f = ", ".join(fam) + ", " if fam else ""
    base = f"""(SELECT {f}model_a, model_b, count(*) AS n, avg(d) AS mean_difference,
       CASE WHEN count(*) > 1 THEN stddev_samp(d) END AS sd_difference,
       CASE WHEN count(*) >= 2 THEN CAST(count(*) - 1 AS INTEGER) END AS degrees_of_freedom
  FROM {diffs} GROUP BY ALL)"""
    t = f"""(SELECT *, CASE WHEN n < 2 THEN NULL WHEN coalesce(sd_difference > 0, false)
             THEN mean_difference / (sd_difference / sqrt(n)) WHEN mean_difference > 0 THEN 'inf'::DOUBLE
             WHEN mean_difference < 0 THEN '-inf'::DOUBLE ELSE 0.0 END AS t_statistic,
          coalesce(sd_difference > 0, false) AS has_sd FROM {base})"""
    p = f"""(SELECT *, CASE WHEN n < 2 THEN NULL WHEN has_sd THEN {d_t_sf2('t_statistic', 'degrees_of_freedom')}
             WHEN mean_difference <> 0 THEN 0.0 ELSE 1.0 END AS p_value,
          CASE WHEN has_sd THEN {d_t_quantile2('0.05', 'degrees_of_freedom')} * sd_difference / sqrt(n) END AS half
        FROM {t})"""
    h = _holm_sql(p, fam, "p_value", "p_value_holm")
    return f"""SELECT {f}model_a, model_b, n, round(mean_difference, 6) AS mean_difference,
  round(sd_difference, 6) AS sd_difference, degrees_of_freedom,
  round(CASE WHEN n < 2 THEN NULL WHEN has_sd THEN mean_difference - half ELSE mean_difference END, 6) AS ci95_low,
  round(CASE WHEN n < 2 THEN NULL WHEN has_sd THEN mean_difference + half ELSE mean_difference END, 6) AS ci95_high,
  round(CASE WHEN has_sd THEN mean_difference / sd_difference ELSE 0.0 END, 9) AS cohen_d_paired,
  CASE WHEN coalesce(mean_difference, 0) > 0 THEN 'may be higher' WHEN coalesce(mean_difference, 0) < 0
       THEN 'may be lower' ELSE 'is equal' END AS direction,
  round(t_statistic, 9) AS t_statistic, round(p_value, 10) AS p_value, round(p_value_holm, 10) AS p_value_holm,
  coalesce(p_value_holm < 0.05, false) AS significant
FROM {h}"""


def _wilcoxon_sql(diffs: str, fam: list[str]) -> str:
    f = ", ".join(fam) + ", " if fam else ""
    pk = ", ".join(fam + ["model_a", "model_b"])
    on = " AND ".join([f"b.{x} IS NOT DISTINCT FROM s.{x}" for x in fam] + ["b.model_a = s.model_a",
                                                                           "b.model_b = s.model_b"])
    base = f"(SELECT {f}model_a, model_b, count(*) AS n, count_if(d = 0) AS n_zero, avg(d) AS md FROM {diffs} GROUP BY ALL)"
    lv = f"""(SELECT *, coalesce(sum(c) OVER (PARTITION BY {pk} ORDER BY absd ROWS BETWEEN UNBOUNDED PRECEDING
                                   AND 1 PRECEDING), 0) AS below
        FROM (SELECT {f}model_a, model_b, abs(d) AS absd, count_if(d > 0) AS pos, count_if(d < 0) AS neg,
                     count(*) AS c FROM {diffs} WHERE d <> 0 GROUP BY ALL))"""
    sums = f"""(SELECT {f}model_a, model_b, sum((below + (c + 1) / 2.0) * pos) AS wp, sum((below + (c + 1) / 2.0) * neg) AS wm,
              CAST(sum(c) AS BIGINT) AS nnz, sum(pow(c, 3) - c) AS tie, max(c) AS maxc FROM {lv} GROUP BY ALL)"""
    j = f"""(SELECT b.*, coalesce(s.wp, 0.0) AS wp, coalesce(s.wm, 0.0) AS wm, coalesce(s.nnz, 0) AS n_nonzero,
               coalesce(s.tie, 0.0) AS tie, coalesce(s.maxc, 0) AS maxc, least(coalesce(s.wp, 0.0), coalesce(s.wm, 0.0)) AS w
        FROM {base} b LEFT JOIN {sums} s ON {on})"""
    exact = "(n_zero = 0 AND maxc <= 1 AND n_nonzero <= 50)"
    p = f"""(SELECT *, CASE WHEN n < 2 THEN NULL WHEN n_nonzero = 0 THEN 1.0
             WHEN {exact} THEN {d_signed_rank_exact('w', 'n_nonzero')}
             ELSE {d_signed_rank_normal('w', 'n_nonzero', 'tie')} END AS p_value FROM {j})"""
    h = _holm_sql(p, fam, "p_value", "p_value_holm")
    return f"""SELECT {f}model_a, model_b, n, n_zero, n_nonzero,
  round(CASE WHEN n < 2 THEN NULL WHEN n_nonzero = 0 THEN 0.0 ELSE w END, 6) AS statistic,
  round(wp, 6) AS positive_rank_sum, round(wm, 6) AS negative_rank_sum,
  round(CASE WHEN wp + wm > 0 THEN (wp - wm) / (wp + wm) ELSE 0.0 END, 9) AS effect,
  CASE WHEN coalesce(md, 0) > 0 THEN 'may be higher' WHEN coalesce(md, 0) < 0 THEN 'may be lower' ELSE 'is equal' END
    AS direction,
  CASE WHEN n < 2 THEN NULL WHEN n_nonzero = 0 THEN 'all-zero' WHEN {exact} THEN 'exact' ELSE 'normal' END AS method,
  round(p_value, 10) AS p_value, round(p_value_holm, 10) AS p_value_holm,
  CASE WHEN {exact} AND n >= 2 AND n_nonzero > 0 THEN least(1.0, pow(2.0, 1 - n_nonzero)) END AS smallest_p,
  coalesce(p_value_holm < 0.05, false) AS significant
FROM {h}"""


def _slice4() -> dict[str, str]:
    q = {}
    comp = _complete(_fold_scores(), [], "block", "treatment", "value")
    comp_s = _complete(_fold_scores(True), ["family"], "block", "treatment", "value")
    q["complete_blocks"] = f"SELECT block, treatment, round(value, 6) AS value FROM {comp}"
    q["applicability"] = f"""WITH raw AS ({_fold_scores(True)}),
k AS (SELECT family, count(DISTINCT treatment) AS treatments FROM raw WHERE value IS NOT NULL GROUP BY family),
n AS (SELECT family, count(DISTINCT block) AS complete_blocks FROM {comp_s} GROUP BY family)
SELECT k.family, treatments, coalesce(complete_blocks, 0) AS complete_blocks,
  treatments >= 3 AND coalesce(complete_blocks, 0) >= 3 AS friedman_available,
  CASE WHEN NOT (treatments >= 3 AND coalesce(complete_blocks, 0) >= 3)
       THEN 'Friedman needs at least 3 treatments and 3 complete blocks.' END AS reason
FROM k LEFT JOIN n ON k.family IS NOT DISTINCT FROM n.family"""
    q["friedman"] = _friedman_sql(comp, [], "block", "treatment", "value")
    q["friedman_by_status"] = _friedman_sql(comp_s, ["family"], "block", "treatment", "value")
    q["paired_t"] = _paired_t_sql(_pairs(comp, [], "block", "treatment", "value"), [])
    q["paired_t_by_status"] = _paired_t_sql(_pairs(comp_s, ["family"], "block", "treatment", "value"), ["family"])
    q["wilcoxon"] = _wilcoxon_sql(_pairs(comp, [], "block", "treatment", "value"), [])
    return q


def _rnd_all(sql: str) -> str:
    """Rewrite every round(expr, d) as the IEEE half-up form used by the Spark queries."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, None
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        if comma is None:
            out.append(sql[i:k + 1])
            i = k + 1
            continue
        expr = _rnd_all(sql[j + 6:comma])
        d = int(sql[comma + 1:k].strip())
        scale = float(10 ** d)
        out.append(sql[i:j])
        out.append(f"(CASE WHEN abs({expr}) < {1e15 / scale!r} THEN floor(({expr}) * {scale!r} + 0.5) / {scale!r} "
                   f"ELSE ({expr}) END)")
        i = k + 1


CVS = f"""{PRED},
cvp AS (SELECT * FROM pred WHERE NOT is_test),
cvc AS (SELECT model, fold, CAST(count_if(y = 1 AND score >= 0.5) AS DOUBLE) AS tp,
               CAST(count_if(y = 0 AND score >= 0.5) AS DOUBLE) AS fp,
               CAST(count_if(y = 1 AND score < 0.5) AS DOUBLE) AS fn FROM cvp GROUP BY ALL),
cvlv AS (SELECT model, fold, score, sum(y) AS pos, sum(1 - y) AS neg FROM cvp GROUP BY ALL),
cva AS (SELECT model, fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg))
                   ELSE 0.0 END AS roc_auc
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, fold ORDER BY score
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM cvlv) GROUP BY ALL),
cvs AS (SELECT model, fold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
               roc_auc, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
        FROM cvc JOIN cva USING (model, fold)),
summ AS (SELECT model, avg(f1) AS cv_f1_mean, coalesce(stddev_samp(f1), 0.0) AS cv_f1_std,
                avg(roc_auc) AS cv_roc_auc_mean, avg(recall) AS cv_recall_mean FROM cvs GROUP BY model)"""
RANK_ORDER = "cv_f1_mean DESC, cv_roc_auc_mean DESC, cv_recall_mean DESC, cv_f1_std ASC, model ASC"


def _slice5() -> dict[str, str]:
    q = {}
    comp = "(SELECT fold, model, f1 FROM cvs)"
    diffs = _pairs(comp, [], "fold", "model", "f1")
    t = _paired_t_sql(diffs, []).replace("round(mean_difference, 6)", "round(mean_difference, 10)")
    w = _wilcoxon_sql(diffs, [])
    q["cv_tests"] = f"""WITH {CVS}, tt AS ({t}), ww AS ({w})
SELECT model_a, model_b, tt.n, tt.mean_difference, round(tt.t_statistic, 6) AS t_statistic, tt.p_value AS t_p_value,
  tt.p_value_holm AS t_p_holm, tt.significant AS t_significant,
  CASE WHEN tt.p_value_holm IS NULL THEN 'Too few blocks to compare.'
       ELSE printf('%s and %s %s by their means at level 0.05 (Holm p=%.5f)', model_a, model_b,
                   CASE WHEN tt.significant THEN 'differ' ELSE 'do not differ' END, tt.p_value_holm) END AS t_interpretation,
  ww.statistic AS w_statistic, ww.p_value AS w_p_value, ww.p_value_holm AS w_p_holm, ww.method AS w_method
FROM tt JOIN ww USING (model_a, model_b)"""
    fr = _friedman_sql("(SELECT * FROM cvs)", [], "fold", "model", "f1")
    q["cv_friedman"] = fr.replace("WITH comp AS (SELECT * FROM cvs)", f"WITH {CVS}, comp AS (SELECT * FROM cvs)").replace(
        "FROM fin", "FROM fin").replace(
        "CASE WHEN NOT available THEN 'Friedman needs at least 3 treatments and 3 complete blocks.' END AS reason",
        "CASE WHEN NOT available THEN 'Friedman needs at least 3 treatments and 3 complete blocks.' END AS reason, "
        "CASE WHEN NOT available THEN 'No overall test: fewer than 3 complete blocks or treatments.' "
        f"ELSE printf('%s (p=%.5f, %d treatments, level 0.05)', CASE WHEN {d_chi2_sf('statistic', 'df')} < 0.05 "
        "THEN 'At least one treatment ranks apart; the paired tests name the pairs' ELSE 'Ranks of the treatments look alike' END, "
        f"{d_chi2_sf('statistic', 'df')}, k) END AS interpretation")
    test = f"""tm AS (SELECT model, CAST(count_if(y = 1 AND score >= 0.5) AS DOUBLE) AS tp,
        CAST(count_if(y = 0 AND score >= 0.5) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND score < 0.5) AS DOUBLE) AS fn
        FROM pred WHERE is_test GROUP BY model),
tlv AS (SELECT model, score, sum(y) AS pos, sum(1 - y) AS neg FROM pred WHERE is_test GROUP BY ALL),
ta AS (SELECT model, sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)) AS roc_auc
       FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM tlv) GROUP BY ALL)"""
    q["model_comparison"] = f"""WITH {CVS}, {test}
SELECT model, CAST(row_number() OVER (ORDER BY {RANK_ORDER}) AS INTEGER) AS rank,
  round(2 * tp / (2 * tp + fp + fn), 10) AS f1, round(roc_auc, 10) AS roc_auc, round(tp / (tp + fn), 10) AS recall,
  round(cv_f1_mean, 10) AS cv_f1_mean, round(cv_f1_std, 10) AS cv_f1_std,
  round(cv_roc_auc_mean, 10) AS cv_roc_auc_mean, round(cv_recall_mean, 10) AS cv_recall_mean
FROM tm JOIN ta USING (model) JOIN summ USING (model)"""
    q["model_means"] = f"WITH {CVS} SELECT model, round(avg(f1), 10) AS mean_f1 FROM cvs GROUP BY model"
    q["cv_page_summary"] = f"""WITH {CVS} SELECT round(avg(f1), 10) AS mean_f1, round(stddev_samp(f1), 10) AS std_f1,
  count(DISTINCT fold) AS folds FROM cvs"""
    q["mcnemar"] = f"""WITH {CVS},
best AS (SELECT model AS best FROM summ ORDER BY {RANK_ORDER} LIMIT 1),
ok AS (SELECT order_key, model, CAST(score >= 0.5 AS INTEGER) = y AS ok FROM pred WHERE is_test),
b AS (SELECT order_key, ok AS best_ok FROM ok, best WHERE model = best.best),
t AS (SELECT best.best, o.model AS competitor,
             count_if(best_ok AND ok) AS both_correct, count_if(best_ok AND NOT ok) AS best_only_correct,
             count_if(NOT best_ok AND ok) AS competitor_only_correct, count_if(NOT best_ok AND NOT ok) AS both_wrong
      FROM ok o JOIN b USING (order_key), best WHERE o.model <> best.best GROUP BY ALL),
s AS (SELECT *, CASE WHEN best_only_correct + competitor_only_correct > 0
                     THEN pow(abs(best_only_correct - competitor_only_correct) - 1.0, 2)
                          / CAST(best_only_correct + competitor_only_correct AS DOUBLE) END AS statistic FROM t)
SELECT best, competitor, both_correct, best_only_correct, competitor_only_correct, both_wrong,
  round(statistic, 9) AS statistic,
  round(CASE WHEN statistic IS NULL THEN 1.0 ELSE {d_chi2_sf('statistic', '1')} END, 12) AS p_value FROM s"""
    comp_s = _complete(_fold_scores(True), ["family"], "block", "treatment", "value")
    pt = _paired_t_sql(_pairs(comp_s, ["family"], "block", "treatment", "value"), ["family"])
    q["significance_counts"] = f"""SELECT family, count_if(significant) AS significant, count(*) AS comparisons
FROM ({pt}) GROUP BY family"""
    q["positive_predictions"] = f"""WITH {PRED} SELECT model, count_if(score >= 0.5) AS positive_predictions,
  count(*) AS rows FROM pred WHERE is_test GROUP BY model"""
    return q


def _slice6() -> dict[str, str]:
    q = {}
    q["rbf_kernel_features"] = """WITH u AS (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i
              FROM embeddings),
c AS (SELECT label AS center, i, avg(CAST(e AS DOUBLE)) AS c FROM u GROUP BY ALL)
SELECT vec_id, center, round(exp(-0.05 * sum((CAST(e AS DOUBLE) - c) * (CAST(e AS DOUBLE) - c))), 10) AS value
FROM u JOIN c USING (i) GROUP BY vec_id, center"""
    q["csv_roundtrip"] = f"WITH {OBS} SELECT * FROM obs"
    q["report_roundtrip"] = _slice5()["model_comparison"]
    q["batch_export"] = _slice1()["threshold_class"]
    cols = ["order_key", "total_price", "account_balance", "order_month", "order_status", "order_priority",
            "market_segment", "result"]
    types = ["bigint", "double", "double", "double", "string", "string", "string", "int"]
    miss = " UNION ALL ".join(
        f"SELECT 'missing', '{c}', CAST(count_if({c} IS NULL"
        + (f" OR isnan({c})" if t == "double" else "") + f") AS DOUBLE), NULL FROM obs" for c, t in zip(cols, types))
    dtypes = " UNION ALL ".join(f"SELECT 'dtype', '{c}', NULL, '{t}'" for c, t in zip(cols, types))
    stats = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q25": "quantile_cont({c}, 0.25)",
             "q50": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})"}
    described = " UNION ALL ".join(
        f"SELECT 'describe', '{c}.{s}', round(CAST({e.format(c=c)} AS DOUBLE), 6), NULL FROM obs"
        for c in ("total_price", "account_balance", "order_month") for s, e in stats.items())
    headers = dict(zip([n for _, n in UPLOAD_COLUMNS], ["order_key", "total_price", "account_balance", "order_month", "order_status", "order_priority",
                                                        "market_segment", "result"]))
    renamed = " UNION ALL ".join(f"SELECT 'column', '{h}', NULL, '{c}'" for h, c in headers.items())
    q["feature_columns"] = f"""WITH {OBS} SELECT order_key, total_price, account_balance, order_month, order_status, order_priority, market_segment,
  CAST(0 AS INTEGER) AS result FROM obs"""
    q["quality_report"] = f"""WITH {OBS}, co AS ({_coerced()})
SELECT 'rows' AS section, CAST(NULL AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text
FROM obs
UNION ALL SELECT 'columns', NULL, 8.0, NULL
UNION ALL SELECT 'duplicates', NULL, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM obs)) AS DOUBLE), NULL
FROM obs
UNION ALL {miss}
UNION ALL SELECT 'class', CAST(result AS VARCHAR), CAST(count(*) AS DOUBLE), NULL FROM obs GROUP BY result
UNION ALL SELECT 'rows_excluded', NULL, CAST(count_if(result_value IS NOT DISTINCT FROM 2.0) AS DOUBLE), NULL FROM co
UNION ALL {dtypes}
UNION ALL {described}
UNION ALL {renamed}
UNION ALL SELECT 'warning', '0', NULL, printf('order_month: %d values are no numbers and count as missing',
  count_if(raw_month IS NOT NULL AND order_month IS NULL)) FROM co
UNION ALL SELECT 'warning', '1', NULL, printf('result: left out %d rows of class 2',
  count_if(result_value IS NOT DISTINCT FROM 2.0)) FROM co"""
    fr = _friedman_sql(_complete(_fold_scores(True), ["family"], "block", "treatment", "value"), ["family"],
                       "block", "treatment", "value")
    pt = _paired_t_sql(_pairs(_complete(_fold_scores(True), ["family"], "block", "treatment", "value"), ["family"],
                              "block", "treatment", "value"), ["family"])
    wx = _wilcoxon_sql(_pairs(_complete(_fold_scores(True), ["family"], "block", "treatment", "value"), ["family"],
                              "block", "treatment", "value"), ["family"])
    u = "(CAST(('0x' || substr(md5(concat(CAST(order_key AS VARCHAR), '|stream')), 1, 8)) AS BIGINT) / 4294967296.0)"
    q["stream_scoring"] = f"""WITH c AS ({_coerced()})
SELECT order_key,
  concat_ws(',', CASE WHEN total_price <= 0 THEN 'price_not_positive' END,
                 CASE WHEN account_balance < 0 THEN 'balance_negative' END,
                 CASE WHEN order_month < 1 OR order_month > 12 THEN 'month_out_of_range' END,
                 CASE WHEN total_price IS NULL THEN 'total_price_missing' END,
                 CASE WHEN account_balance IS NULL THEN 'account_balance_missing' END,
                 CASE WHEN order_month IS NULL THEN 'order_month_missing' END) AS violations,
  round({u}, 10) AS score, CAST({u} >= 0.5 AS INTEGER) AS predicted_class,
  CASE WHEN {u} >= 0.5 THEN 'Irrigation required' ELSE 'No irrigation required' END AS recommendation
FROM c"""
    q["labelled_join_profile"] = """WITH j AS (SELECT d.doc_id, lang, source, n_chars, quality
                 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'lang' AS "column", lang AS category, quality AS class, count(*) AS rows, round(avg(n_chars), 6) AS mean_chars
FROM j GROUP BY ALL
UNION ALL
SELECT 'source', source, quality, count(*), round(avg(n_chars), 6) FROM j GROUP BY ALL"""
    q["overall_interpretation"] = f"""WITH f AS ({fr}), t AS ({pt}), w AS ({wx}),
ts AS (SELECT family, count_if(significant) AS t_sig, count(*) AS t_all FROM t GROUP BY family),
ws AS (SELECT family, count_if(significant) AS w_sig, count(*) AS w_all FROM w GROUP BY family)
SELECT f.family, concat_ws(' ',
  CASE WHEN NOT available THEN 'Too few complete blocks for an overall test.'
       WHEN p_value < 0.05 THEN 'Overall, the treatments are not all alike (Friedman).'
       ELSE 'Overall, the treatments can''t be told apart (Friedman).' END,
  printf('Pairs that differ after Holm: %d of %d by the t test, %d of %d by signed ranks.',
         coalesce(t_sig, 0), coalesce(t_all, 0), coalesce(w_sig, 0), coalesce(w_all, 0))) AS interpretation
FROM f LEFT JOIN ts ON f.family = ts.family LEFT JOIN ws ON f.family = ws.family"""
    return q


def _model_checks() -> dict[str, str]:
    """What any right fit returns: exact quotas of rows, and every check true.

    Quotas by largest remainder as in the hold-out split; fold sizes by
    position in the line of training rows, class after class.
    """
    quota = """n AS (SELECT CAST(embedding[1] + embedding[2] > embedding[3] AS INTEGER) AS y, count(*) AS n FROM embeddings GROUP BY 1),
t AS (SELECT y, n, sum(n) OVER () - CAST(ceil(0.2 * sum(n) OVER ()) AS BIGINT) AS draws, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM n),
f AS (SELECT *, CAST(floor(share * draws) AS BIGINT) AS whole, share * draws - floor(share * draws) AS part FROM t),
q AS (SELECT y, n, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, y) <= draws - sum(whole) OVER () THEN 1 ELSE 0 END AS train FROM f)"""
    ok = "true AS scores_valid, true AS counts_add_up, true AS auc_above_floor, true AS f1_above_floor"
    out = {f"{name.lower()}_fit_score": f"""WITH {quota}
SELECT '{name}' AS model, CAST(sum(n - train) AS BIGINT) AS rows, CAST(sum(CASE WHEN y = 1 THEN n - train ELSE 0 END) AS BIGINT) AS positives, {ok} FROM q"""
           for name in ("MLP", "DNN", "RBF")}
    out["cross_validate"] = f"""WITH {quota},
l AS (SELECT y, train, coalesce(sum(train) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
r AS (SELECT y, (before + unnest(range(0, CAST(train AS BIGINT)))) % 5 + 1 AS fold FROM l)
SELECT model, CAST(fold AS INTEGER) AS fold, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, {ok}
FROM r, (VALUES ('MLP'), ('DNN'), ('RBF')) m(model) GROUP BY model, fold"""
    out["tune"] = """SELECT CAST(4 AS BIGINT) AS trials, CAST(4 AS BIGINT) AS settings, CAST(1 AS BIGINT) AS best, true AS best_is_highest,
true AS f1_above_floor, true AS settings_matter"""
    out["tune_step_size"] = """SELECT CAST(8 AS BIGINT) AS trials, CAST(8 AS BIGINT) AS step_sizes, true AS steps_in_range, CAST(2 AS BIGINT) AS trained_to_the_end,
CAST(1 AS BIGINT) AS best, true AS best_is_highest, true AS auc_above_floor, true AS settings_matter"""
    h = """CAST(('0x' || substr(md5(concat(CAST(vec_id AS VARCHAR), '|split|42')), 1, 15)) AS BIGINT)"""
    out["persist_roundtrip"] = f"""WITH {quota},
k AS (SELECT vec_id, y, row_number() OVER (PARTITION BY y ORDER BY {h}, vec_id) AS rank
      FROM (SELECT vec_id, CAST(embedding[1] + embedding[2] > embedding[3] AS INTEGER) AS y FROM embeddings))
SELECT vec_id, true AS same_score, CAST(0.5 AS DOUBLE) AS threshold, 'MLP' AS model FROM k JOIN q USING (y) WHERE rank <= n - train"""
    return out


def _prepared() -> dict[str, str]:
    """The preparation as a pipeline stage, and validation in one evaluation."""
    base = _slice2()["preprocess_apply"]
    hot = " + ".join(f'"{c}={v}"' for c, levels in CAT_LEVELS.items() for v in levels)
    return {
        "prepared_values": f"SELECT order_key, CAST({len(NUM) + sum(map(len, CAT_LEVELS.values()))} AS INTEGER) AS width, {', '.join(NUM)}, {hot} AS levels_set FROM ({base})",
        "onehot_sparse": """WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
t AS (SELECT * FROM c WHERE c_custkey % 5 <> 0),
a AS (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS id FROM (SELECT DISTINCT c_name FROM t)),
b AS (SELECT segment AS v, row_number() OVER (ORDER BY segment) - 1 AS id FROM (SELECT DISTINCT segment FROM t WHERE segment IS NOT NULL)),
m AS (SELECT arg_min(segment, (-n, segment)) AS v FROM (SELECT segment, count(*) AS n FROM t WHERE segment IS NOT NULL GROUP BY segment)),
w AS (SELECT (SELECT count(*) FROM a) AS wa, (SELECT count(*) FROM b) AS wb)
SELECT c_custkey, wa + wb AS width, concat_ws(',', a.id, wa + b.id) AS indices
FROM c CROSS JOIN m CROSS JOIN w LEFT JOIN a ON c_name = a.v LEFT JOIN b ON coalesce(segment, m.v) = b.v""",
        "pipeline_persist": f"WITH {SPLIT} SELECT order_key, true AS same_score, true AS score_valid FROM split WHERE is_test",
        "stream_model_scoring": "SELECT o_orderkey AS order_key, true AS same_score, true AS class_fits FROM orders",
        "describe_sketch": f'SELECT "column", "count", mean, std, "min", "max", true AS quartiles_fit FROM ({_slice1()["describe_lineitem"]})',
        "clean_observed": f"""WITH {OBS}
SELECT obs.*, rows_in, rows_excluded, rows_invalid, non_numeric_order_month, n_classes FROM obs CROSS JOIN ({_slice1()["validation_counters"]})""",
        "quarantine_observed": _slice1()["quarantine"],
    }


def _sources() -> dict[str, str]:
    return {
        "csv_missing_words": """SELECT segment, count(*) AS rows, count(units) AS known, CAST(sum(units) AS BIGINT) AS total
FROM (SELECT CASE WHEN c_custkey % 5 > 2 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 100 END AS units FROM customer)
GROUP BY segment""",
        "csv_multiline": """SELECT c_custkey AS k, concat('line one of ', c_mktsegment, chr(10), 'said "two", and 3') AS note FROM customer""",
        "csv_multiline_split": """SELECT o_orderkey AS k, concat(o_orderpriority, repeat(concat(chr(10), 'said "it", then 3'), CAST(o_orderkey % 5 AS INTEGER))) AS note,
            o_orderstatus AS status FROM orders""",
        "newest_file": "SELECT n_nationkey, n_name, CAST(2 AS INTEGER) AS upload FROM nation",
    }


def _bigint_counts(sql: str) -> str:
    """count_if yields HUGEINT in DuckDB; Spark's count_if is BIGINT. Cast every call."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("count_if(")
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            k += 1
        inner = _bigint_counts(sql[j + len("count_if("):k])
        out.append(sql[i:j])
        out.append(f"CAST(count_if({inner}) AS BIGINT)")
        i = k + 1


def _report(q: dict[str, str]) -> dict[str, str]:
    """What each column of each report table holds."""
    from tessera.plans.queries import REPORT_TABLES
    cells = " UNION ALL ".join(
        f"""SELECT '{name}' AS report_table, "column", text FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({q[query]})) UNPIVOT INCLUDE NULLS (text FOR "column" IN (COLUMNS(*)))"""
        for name, query in REPORT_TABLES.items())
    return {"report_json_roundtrip": f"""SELECT report_table, "column", count(*) AS rows, count(text) AS filled, count(DISTINCT number) AS numbers, min(number) AS least, max(number) AS greatest,
  count(DISTINCT word) AS words, min(word) AS first_word, max(word) AS last_word
FROM (SELECT *, CASE WHEN number IS NULL THEN text END AS word FROM (SELECT *, TRY_CAST(text AS DOUBLE) AS number FROM ({cells})))
GROUP BY ALL"""}


def oracle_sql() -> dict[str, str]:
    q = {}
    q.update(_slice1())
    q.update(_slice2())
    q.update(_slice3())
    q.update(_slice4())
    q.update(_slice5())
    q.update(_slice6())
    q.update(_model_checks())
    q.update(_sources())
    q.update(_prepared())
    q.update(_report(q))
    return {k: _bigint_counts(_rnd_all(v)) for k, v in q.items()}

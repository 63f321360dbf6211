"""Independent SQL for every query that SQL can express over the whole tables."""

from __future__ import annotations

VISITS = """
WITH li AS (SELECT l_orderkey, MAX(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderdate AS ts, o.o_orderstatus AS st, o.o_orderpriority AS pr,
         CAST(FLOOR(o.o_totalprice / 1000) AS BIGINT) AS tp, li.q AS q, c.c_mktsegment AS seg
  FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey),
v AS (
  SELECT *, CAST(30 + 3 * q AS DOUBLE) AS hr0, CAST(60 + tp % 150 AS DOUBLE) AS sbp0,
         CAST(75 + (k * 11) % 26 AS DOUBLE) AS spo20, CAST(340 + (k * 17) % 61 AS DOUBLE) / 10 AS temp0
  FROM b)
SELECT k AS visit_id, ck AS patient_id, ts AS arrival_ts, st AS arrival_mode,
  CASE WHEN k % 11 = 3 THEN NULL ELSE seg END AS complaint,
  CAST(ck % 101 AS DOUBLE) AS age, hr0 AS hr, sbp0 AS sbp,
  CASE WHEN k % 8 = 5 THEN NULL ELSE CAST(40 + FLOOR(sbp0 / 3) + k % 17 AS DOUBLE) END AS dbp,
  CASE WHEN k % 23 = 7 THEN NULL ELSE spo20 END AS spo2,
  CASE WHEN k % 6 = 1 THEN NULL ELSE temp0 END AS temp,
  CASE WHEN k % 50 = 9 THEN NULL ELSE CAST(3 + (k * 5) % 13 AS DOUBLE) END AS gcs,
  CASE WHEN k % 40 = 11 THEN 'n/a' ELSE CAST(k % 11 AS VARCHAR(8)) END AS pain_raw,
  CASE WHEN k % 10 = 0 THEN CASE WHEN pr = '1-URGENT' THEN 'RED' WHEN pr = '2-HIGH' THEN 'YELLOW' ELSE 'GREEN' END
       WHEN spo20 < 79 OR sbp0 < 66 THEN 'RED' WHEN spo20 < 82 THEN 'YELLOW' ELSE 'GREEN' END AS triage
FROM v
"""

PREDS = """
SELECT visit_id, patient_id, arrival_ts, arrival_mode, age, triage AS y_true,
  CASE WHEN spo2 < 80 OR sbp < 66 THEN 'RED' WHEN spo2 < 83 THEN 'YELLOW' ELSE 'GREEN' END AS y_pred,
  CASE WHEN sbp < 70 OR temp > 39.5e0 THEN 'RED' WHEN temp > 39 THEN 'YELLOW' ELSE 'GREEN' END AS y_pred_b,
  wr / (wr + wy + wg) AS p_red, wy / (wr + wy + wg) AS p_yellow, wg / (wr + wy + wg) AS p_green
FROM (SELECT *,
  CAST(1 + CASE WHEN spo2 < 82 THEN 6 ELSE 0 END + visit_id % 3 AS DOUBLE) AS wr,
  CAST(1 + CASE WHEN spo2 BETWEEN 79 AND 84 THEN 5 ELSE 0 END + visit_id % 2 AS DOUBLE) AS wy,
  CAST(2 + CASE WHEN spo2 >= 82 THEN 8 ELSE 0 END + visit_id % 5 AS DOUBLE) AS wg FROM visits) s
"""

ORACLES: dict[str, str] = {}

VITALS = ("hr", "spo2", "sbp", "dbp", "temp", "gcs")
PROFILED = ("arrival_mode", "complaint", "hr", "sbp", "dbp", "spo2", "temp", "gcs", "triage")
MODEL_FEATURES = ("age", "hr", "sbp", "dbp", "spo2", "temp", "gcs")
NEAR = ("hr", "sbp", "spo2", "gcs")
PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CLASSES = ("GREEN", "RED", "YELLOW")
SCORES = {"RED": "p_red", "YELLOW": "p_yellow", "GREEN": "p_green"}


def sql(name: str, body: str, ctes: str = "") -> None:
    ORACLES[name] = f"WITH visits AS MATERIALIZED ({VISITS}), preds AS MATERIALIZED ({PREDS}){', ' + ctes if ctes else ''}\n{body}"


def plain(name: str, body: str) -> None:
    ORACLES[name] = body


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 AS {name}"


def union(template: str, items) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in items)


def comma(template: str, items) -> str:
    return ", ".join(template.format(c=c) for c in items)


def hash32(prefix: str, key: str, at: int = 1) -> str:
    return f"CAST(('0x' || substr(md5('{prefix}|' || {key}), {at}, 8)) AS BIGINT)"


def key(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


# ---- scans, projections, filters ------------------------------------------------------------------------

sql("scan_visits", "SELECT * FROM visits")
plain("scan_table", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
_TYPES = (("visit_id", "bigint"), ("patient_id", "bigint"), ("arrival_ts", "timestamp_ntz"), ("arrival_mode", "string"),
          ("complaint", "string"), ("age", "double"), ("hr", "double"), ("sbp", "double"), ("dbp", "double"),
          ("spo2", "double"), ("temp", "double"), ("gcs", "double"), ("pain_raw", "string"), ("triage", "string"))
_LISTED = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_TYPES))
sql("dataset_info", f"""SELECT (SELECT count(*) FROM visits) AS n_rows, 14 AS n_columns, t.p AS position,
    t.c AS "column", t.d AS dtype FROM (VALUES {_LISTED}) t(p, c, d)""")
sql("coerce_numeric", "SELECT visit_id, try_cast(pain_raw AS DOUBLE) AS pain FROM visits")
sql("select_numeric", "SELECT visit_id, age, hr, sbp, dbp, spo2, temp, gcs FROM visits")
sql("align_schema", "SELECT visit_id, sbp, 0e0 AS by_ambulance, hr, age FROM visits")
sql("complete_cases", f"""SELECT visit_id, {', '.join(VITALS)}, complaint FROM visits
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*VITALS, 'complaint'))}""")
_RISK = """CASE WHEN y_true = 'RED' AND y_pred IN ('YELLOW', 'GREEN') THEN 'critical'
    WHEN y_true = 'YELLOW' AND y_pred = 'GREEN' THEN 'important'
    WHEN y_true = 'GREEN' AND y_pred IN ('RED', 'YELLOW') THEN 'over_triage' END"""
sql("high_risk_cases", f"SELECT * FROM (SELECT visit_id, y_true, y_pred, {_RISK} AS risk FROM preds) WHERE risk IS NOT NULL")
sql("variance_filter", "SELECT feature FROM (" + union(
    "SELECT '{c}' AS feature, var_samp({c}) AS v FROM visits", ("age", *VITALS))
    + " UNION ALL SELECT 'site', 0 FROM visits) WHERE v > 1e-6 GROUP BY feature")
sql("clean_numeric", f"""SELECT visit_id, {r("coalesce(x, (SELECT median(x) FROM t))", "hr")},
    {r("coalesce(dbp, (SELECT median(dbp) FROM t))", "dbp")} FROM t""",
    "t AS (SELECT visit_id, CASE WHEN sbp = 61 THEN NULL ELSE hr END AS x, dbp FROM visits)")
_BAND = """CASE WHEN age > 0 AND age <= 18 THEN 'Young' WHEN age > 18 AND age <= 40 THEN 'Adult'
    WHEN age > 40 AND age <= 65 THEN 'Middle' WHEN age > 65 AND age <= 100 THEN 'Elderly' END"""
sql("age_category", f"""SELECT visit_id, {_BAND} AS age_category,
    CASE WHEN age >= 65 THEN 1 ELSE 0 END AS elderly_flag FROM visits""")
sql("label_encode", """SELECT visit_id, v.triage, c.code, v.triage AS decoded FROM visits v
    JOIN (SELECT triage, CAST(row_number() OVER (ORDER BY triage) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT triage FROM visits)) c USING (triage)""")
plain("label_encode_customers", """SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS code FROM orders""")
plain("one_hot_customers", """SELECT CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS code, n
    FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)""")
sql("impute_knn_lsh_checked", "SELECT count(*) AS n, count(*) AS answered, TRUE AS recalled FROM visits WHERE dbp IS NULL")
sql("one_hot", "SELECT visit_id, " + comma("CASE WHEN arrival_mode = '{c}' THEN 1 ELSE 0 END AS \"arrival_mode_{c}\"", "FOP")
    + ", " + comma("CASE WHEN complaint = '{c}' THEN 1 ELSE 0 END AS \"complaint_{c}\"",
                   ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM visits")
sql("binarize_label", "SELECT visit_id, triage, " + comma("CASE WHEN triage = '{c}' THEN 1 ELSE 0 END AS \"is_{c}\"", CLASSES)
    + " FROM visits")
_WEIGHTS = """n AS (SELECT triage, count(*) AS n FROM visits GROUP BY triage),
    w AS (SELECT triage, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * CAST(n AS DOUBLE)) AS w FROM n)"""
sql("row_weights", f"""SELECT visit_id, triage, {r("w / (SELECT avg(w) FROM w)", "weight")}
    FROM visits JOIN w USING (triage)""", _WEIGHTS)


def ranked(source: str, key_col: str, by: str | None, seed: int) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, row_number() OVER ({part} ORDER BY {hash32(str(seed), key(key_col))}, {key_col}) AS rn,
        count(*) OVER ({part}) AS n FROM {source}"""


def three_way(source: str, key_col: str, by: str | None) -> str:
    return f"""SELECT *, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + floor(0.15e0 / (1e0 - 0.15e0) * (n - t) + 0.5e0)
        THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, floor(0.15e0 * n + 0.5e0) AS t FROM ({ranked(source, key_col, by, 42)}))"""


_SPLIT = f"s AS (SELECT visit_id, triage, split FROM ({three_way('visits', 'visit_id', 'triage')}))"
sql("concat_splits", "SELECT visit_id, triage, split FROM s WHERE split <> 'test'", _SPLIT)
sql("top_n", "SELECT visit_id, hr, sbp FROM visits ORDER BY hr DESC NULLS LAST, visit_id LIMIT 20")
sql("scalar_math", f"""SELECT visit_id, {r("abs(temp - 37e0)", "from_normal")},
    {r("CASE WHEN hr IS NULL THEN NULL WHEN hr < 60 THEN 60e0 WHEN hr > 150 THEN 150e0 ELSE hr END", "hr_clipped")},
    {r("CASE WHEN sbp <> 61 THEN hr / sbp END", "hr_per_sbp")},
    CASE WHEN sbp = 61 THEN 1 ELSE 0 END AS was_inf FROM visits""")

# ---- missing data ---------------------------------------------------------------------------------------

_TYPE = dict(_TYPES)
_MISSING = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{_TYPE[c]}' AS dtype, count(*) - count({c}) AS missing_count, count(*) AS n,
    count(DISTINCT {c}) AS distinct_values FROM visits""" for c in PROFILED)
for _name in ("missing_profile", "missing_profile_added"):
    sql(_name, f"""SELECT "column", dtype, missing_count, {r("100e0 * missing_count / n", "missing_pct")},
        distinct_values, missing_count * 100e0 / n > 50 AS critical FROM m""", f"m AS ({_MISSING})")
sql("missing_totals", f"""SELECT CAST(sum(n) AS BIGINT) AS total_cells, CAST(sum(missing_count) AS BIGINT) AS missing_cells,
    {r("100e0 * sum(missing_count) / sum(n)", "missing_pct")},
    CAST(count(*) FILTER (missing_count > 0) AS INTEGER) AS columns_with_missing,
    CAST(count(*) FILTER (missing_count * 100e0 / n > 50) AS INTEGER) AS columns_critical FROM m""", f"m AS ({_MISSING})")
sql("missing_patterns", "SELECT pattern, count(*) AS n FROM (SELECT "
    + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PROFILED) + " AS pattern FROM visits) GROUP BY pattern")
_NULLED = ("hr", "dbp", "spo2", "temp", "gcs", "sbp")
sql("nullity_corr", f"""SELECT column_a, column_b, {r("c", "corr")} FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr(i_{a}, i_{b}) AS c FROM f"
    for i, a in enumerate(_NULLED) for b in _NULLED[i + 1:]) + ") WHERE c IS NOT NULL AND NOT isnan(c)",
    "f AS (SELECT " + comma("CAST({c} IS NULL AS INTEGER) AS i_{c}", _NULLED) + " FROM visits)")
sql("missing_indicators", "SELECT visit_id, " + comma("CAST({c} IS NULL AS INTEGER) AS {c}_was_missing",
                                                      ("dbp", "temp", "complaint")) + " FROM visits")
_MEDIANS = "md AS (SELECT " + comma("median({c}) AS m_{c}", MODEL_FEATURES) + " FROM visits)"
sql("impute_median", "SELECT visit_id, " + comma("coalesce({c}, m_{c}) AS {c}", VITALS) + " FROM visits, md", _MEDIANS)
_MODE = """mo AS (SELECT complaint AS m FROM visits WHERE complaint IS NOT NULL GROUP BY complaint
    ORDER BY count(*) DESC, complaint LIMIT 1)"""
sql("impute_mode", "SELECT visit_id, coalesce(complaint, m) AS complaint FROM visits, mo", _MODE)
sql("correlated_features", f"""SELECT feature, {r("c", "corr")} FROM c
    ORDER BY round(abs(c), 12) DESC, feature LIMIT 6""",
    "c AS (SELECT 'dbp' AS feature, 1e0 AS c UNION ALL " + union(
        "SELECT '{c}', corr({c}, dbp) FROM visits", ("age", "hr", "spo2", "sbp", "temp", "gcs")) + ")")

_KD = ("hr", "sbp", "spo2", "gcs", "age")
sql("impute_knn", f"""SELECT visit_id, {r("coalesce(dbp, f, (SELECT avg(dbp) FROM visits))", "dbp")},
    hr, sbp, spo2, gcs, age FROM visits LEFT JOIN fills USING (visit_id)""", f"""
  pairs AS (SELECT q.visit_id, d.visit_id AS did, d.dbp AS v,
    {' + '.join(f'coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0e0)' for c in _KD)} AS s,
    {' + '.join(f'CAST(q.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)' for c in _KD)} AS shared
    FROM visits q, visits d WHERE q.dbp IS NULL AND d.dbp IS NOT NULL),
  best AS (SELECT visit_id, arg_min(v, (5e0 / shared * s, did), 5) AS near FROM pairs WHERE shared > 0 GROUP BY visit_id),
  fills AS (SELECT visit_id, list_avg(near) AS f FROM best)""")


def _regress(y: str, a: str, b: str, rows: str) -> str:
    """Two-predictor least squares on the rows where y was observed."""
    return f"""SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb,
    (covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop({a}, {b}))
      / (var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b})) AS ba,
    (covar_pop({b}, {y}) * var_pop({a}) - covar_pop({a}, {y}) * covar_pop({a}, {b}))
      / (var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b})) AS bb FROM {rows}"""


sql("impute_chained_linear", f"SELECT visit_id, {r('hr', 'hr')}, {r('spo2', 'spo2')}, {r('temp', 'temp')} FROM c3", f"""
  c0 AS (SELECT visit_id, hr IS NULL AS gh, spo2 IS NULL AS gs, temp IS NULL AS gt,
    coalesce(hr, (SELECT avg(hr) FROM visits)) AS hr, coalesce(spo2, (SELECT avg(spo2) FROM visits)) AS spo2,
    coalesce(temp, (SELECT avg(temp) FROM visits)) AS temp FROM visits),
  e1 AS ({_regress("hr", "spo2", "temp", "c0 WHERE NOT gh")}),
  c1 AS (SELECT visit_id, gh, gs, gt, CASE WHEN gh THEN my + ba * (spo2 - ma) + bb * (temp - mb) ELSE hr END AS hr,
    spo2, temp FROM c0, e1),
  e2 AS ({_regress("spo2", "hr", "temp", "c1 WHERE NOT gs")}),
  c2 AS (SELECT visit_id, gh, gs, gt, hr, CASE WHEN gs THEN my + ba * (hr - ma) + bb * (temp - mb) ELSE spo2 END AS spo2,
    temp FROM c1, e2),
  e3 AS ({_regress("temp", "hr", "spo2", "c2 WHERE NOT gt")}),
  c3 AS (SELECT visit_id, hr, spo2, CASE WHEN gt THEN my + ba * (hr - ma) + bb * (spo2 - mb) ELSE temp END AS temp
    FROM c2, e3)""")

sql("imputation_log", """SELECT * FROM (
    SELECT 'hr' AS "column", 'chained' AS method, (SELECT count(*) - count(hr) FROM visits) AS missing_before
    UNION ALL SELECT 'pain', 'median', (SELECT count(*) - count(try_cast(pain_raw AS DOUBLE)) FROM visits)
    UNION ALL SELECT 'complaint', 'mode', (SELECT count(*) - count(complaint) FROM visits)
    UNION ALL SELECT 'complaint', 'indicator', (SELECT count(*) - count(complaint) FROM visits))""")
_AFTER = f"{_MEDIANS}, {_MODE}, after AS (SELECT visit_id, arrival_mode, " + comma("coalesce({c}, m_{c}) AS {c}", VITALS) \
    + ", coalesce(complaint, m) AS complaint FROM visits, md, mo)"
_GAPPY = ("hr", "spo2", "dbp", "temp", "gcs")
_NUM_Q = " UNION ALL ".join(f"""SELECT '{c}' AS "column", b.n AS missing_before, a.n AS missing_after, b.p AS pct_before,
    a.p AS pct_after, b.m AS mean_before, a.m AS mean_after, b.s AS std_before, a.s AS std_after,
    NULL AS mode_before, NULL AS mode_after, NULL AS unique_before, NULL AS unique_after,
    abs(a.m - b.m) AS mean_change, abs(a.s - b.s) AS std_change, abs(a.m - b.m) < 0.05e0 * b.s AS preserved
    FROM (SELECT count(*) - count({c}) AS n, 100e0 * (count(*) - count({c})) / count(*) AS p, avg({c}) AS m,
          stddev_samp({c}) AS s FROM visits) b,
         (SELECT count(*) - count({c}) AS n, 100e0 * (count(*) - count({c})) / count(*) AS p, avg({c}) AS m,
          stddev_samp({c}) AS s FROM after) a""" for c in _GAPPY)
_TEXT_Q = """SELECT 'complaint', b.n, a.n, b.p, a.p, NULL, NULL, NULL, NULL, b.m, a.m, b.u, a.u, NULL, NULL, b.m = a.m
    FROM (SELECT count(*) - count(complaint) AS n, 100e0 * (count(*) - count(complaint)) / count(*) AS p,
          (SELECT m FROM mo) AS m, count(DISTINCT complaint) AS u FROM visits) b,
         (SELECT count(*) - count(complaint) AS n, 100e0 * (count(*) - count(complaint)) / count(*) AS p,
          (SELECT complaint FROM after GROUP BY complaint ORDER BY count(*) DESC, complaint LIMIT 1) AS m,
          count(DISTINCT complaint) AS u FROM after) a"""
_QD = ("pct_before", "pct_after", "mean_before", "mean_after", "std_before", "std_after", "mean_change", "std_change")
sql("imputation_quality", f"""SELECT "column", missing_before, missing_after, mode_before, mode_after,
    CAST(unique_before AS BIGINT) AS unique_before, CAST(unique_after AS BIGINT) AS unique_after, preserved,
    {', '.join(r(f'CAST({c} AS DOUBLE)', c) for c in _QD)} FROM ({_NUM_Q} UNION ALL {_TEXT_Q})
    WHERE missing_before > 0""", _AFTER)
_GONE = " + ".join(f"count(*) - count({c})" for c in (*VITALS, "complaint"))
sql("imputation_success", f"""SELECT b.n AS missing_before, a.n AS missing_after,
    {r("CASE WHEN b.n = 0 THEN 100e0 ELSE 100e0 * (b.n - a.n) / b.n END", "success_pct")}
    FROM (SELECT {_GONE} AS n FROM visits) b, (SELECT {_GONE} AS n FROM after) a""", _AFTER)
_ALL = (*VITALS, "complaint", "arrival_mode")


def _facts(source: str) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in _ALL)
    columns = " + ".join(f"CAST(count(*) > count({c}) AS BIGINT)" for c in _ALL)
    gone = " + ".join(f"count(*) - count({c})" for c in _ALL)
    return f"""SELECT 'complete_cases' AS metric, count(*) FILTER ({whole}) AS x FROM {source}
    UNION ALL SELECT 'columns_with_missing', {columns} FROM {source} UNION ALL SELECT 'missing_values', {gone} FROM {source}"""


sql("improvement_table", f"""SELECT metric, b.x AS before, a.x AS after, a.x - b.x AS difference,
    {r("CASE WHEN b.x <> 0 THEN 100e0 * (a.x - b.x) / b.x END", "change_pct")}
    FROM ({_facts('visits')}) b JOIN ({_facts('after')}) a USING (metric)""", _AFTER)

# ---- features -------------------------------------------------------------------------------------------

_G2 = """g AS (SELECT sum(h * h) AS hh, sum(s * s) AS ss, sum(h * s) AS hs
    FROM (SELECT coalesce(hr, (SELECT median(hr) FROM visits)) AS h, sbp AS s FROM visits)),
    f AS (SELECT 1 / (1 - hs * hs / (hh * ss)) AS v FROM g),
    t AS (SELECT u.feature, v AS vif, CASE WHEN v <= 5 THEN 'Low (<5)' WHEN v <= 10 THEN 'Moderate (5-10)'
      WHEN v <= 100 THEN 'High (10-100)' ELSE 'Severe (>100)' END AS vif_category
      FROM f, (VALUES ('hr'), ('sbp')) u(feature))"""
sql("vif", f"SELECT feature, {r('vif', 'vif')}, vif_category FROM t", _G2)
sql("vif_bands", "SELECT vif_category, count(*) AS n FROM t GROUP BY vif_category", _G2)
sql("drop_collinear", f"""SELECT * FROM (
      SELECT 1 AS step, feature, {r('v', 'vif')} FROM (SELECT * FROM v3 WHERE v > 10 ORDER BY v DESC, feature LIMIT 1)
      UNION ALL
      SELECT 2, feature, round(v, 6) + 0e0 FROM (SELECT * FROM v2 WHERE v > 10 AND EXISTS (SELECT 1 FROM v3 WHERE v > 10)
        ORDER BY v DESC, feature LIMIT 1))""", """
  x AS (SELECT coalesce(hr, (SELECT median(hr) FROM visits)) AS a, sbp AS b,
    coalesce(spo2, (SELECT median(spo2) FROM visits)) AS c FROM visits),
  p AS (SELECT sum(a*a) AS aa, sum(b*b) AS bb, sum(c*c) AS cc, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*c) AS bc FROM x),
  q AS (SELECT ab / sqrt(aa*bb) AS ab, ac / sqrt(aa*cc) AS ac, bc / sqrt(bb*cc) AS bc FROM p),
  dt AS (SELECT *, 1 + 2*ab*ac*bc - ab*ab - ac*ac - bc*bc AS det FROM q),
  v3 AS (SELECT 'hr' AS feature, (1 - bc*bc) / det AS v FROM dt UNION ALL SELECT 'sbp', (1 - ac*ac) / det FROM dt
    UNION ALL SELECT 'spo2', (1 - ab*ab) / det FROM dt),
  worst AS (SELECT feature FROM v3 ORDER BY v DESC, feature LIMIT 1),
  rest AS (SELECT CASE (SELECT feature FROM worst) WHEN 'hr' THEN bc WHEN 'sbp' THEN ac ELSE ab END AS z FROM dt),
  v2 AS (SELECT f.feature, 1 / (1 - z*z) AS v FROM rest, (VALUES ('hr'), ('sbp'), ('spo2')) f(feature)
    WHERE f.feature <> (SELECT feature FROM worst))""")


def _iqr(source: str, columns) -> str:
    quart = union("SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
                  "count(*) AS n FROM " + source, columns)
    long = union("SELECT '{c}' AS feature, {c} AS x FROM " + source, columns)
    return f"""fence AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM ({quart})),
    iqr AS (SELECT feature, q1, q3, lower, upper, n, count(*) FILTER (x < lower OR x > upper) AS iqr_outliers
      FROM fence JOIN ({long}) USING (feature) GROUP BY ALL)"""


def _zscore(source: str, columns) -> str:
    filled = union("SELECT '{c}' AS feature, coalesce({c}, (SELECT median({c}) FROM " + source + ")) AS x FROM " + source,
                   columns)
    return f"""filled AS ({filled}), zs AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM filled GROUP BY feature),
    z AS (SELECT feature, count(*) AS n, count(*) FILTER (abs((x - m) / s) > 3) AS z_outliers
      FROM filled JOIN zs USING (feature) GROUP BY feature)"""


_IQR_OUT = f"""SELECT feature, {r('q1', 'q1')}, {r('q3', 'q3')}, {r('lower', 'lower')}, {r('upper', 'upper')},
    iqr_outliers, {r('100e0 * iqr_outliers / n', 'iqr_pct')} FROM iqr"""
sql("outliers_iqr", _IQR_OUT, _iqr("visits", ("age", *VITALS)))
plain("outliers_iqr_prices", f"WITH {_iqr('lineitem', PRICES)} {_IQR_OUT}")
sql("outliers_zscore", f"SELECT feature, z_outliers, {r('100e0 * z_outliers / n', 'z_pct')} FROM z",
    _zscore("visits", ("age", *VITALS)))
sql("outlier_report", f"""SELECT feature, iqr_outliers, {r('100e0 * iqr_outliers / iqr.n', 'iqr_pct')}, z_outliers,
    {r('100e0 * z_outliers / z.n', 'z_pct')}, CAST(100e0 * iqr_outliers / iqr.n > 10 AS INTEGER) AS over_10,
    CAST(100e0 * iqr_outliers / iqr.n > 20 AS INTEGER) AS over_20 FROM iqr JOIN z USING (feature)""",
    f"{_iqr('visits', VITALS)}, {_zscore('visits', VITALS)}")
sql("winsorize", "SELECT visit_id, " + ", ".join(r(
    f"""CASE WHEN {c} IS NULL OR (SELECT 100e0 * iqr_outliers / n FROM iqr WHERE feature = '{c}') <= 1 THEN {c}
    ELSE least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM visits)), (SELECT quantile_cont({c}, 0.99) FROM visits)) END""",
    c) for c in VITALS) + " FROM visits", _iqr("visits", VITALS))
sql("log_transform", f"SELECT visit_id, age, hr, {r('ln(1 + sbp)', 'sbp')} FROM visits")
sql("scale_robust", "SELECT visit_id, " + ", ".join(r(f"({c} - m_{c}) / w_{c}", c) for c in VITALS) + " FROM visits, sc",
    "sc AS (SELECT " + comma("median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}", VITALS)
    + " FROM visits)")
sql("scale_standard", "SELECT visit_id, " + ", ".join(r(f"({c} - m_{c}) / w_{c}", c) for c in VITALS) + " FROM visits, sc",
    "sc AS (SELECT " + comma("avg({c}) AS m_{c}, stddev_pop({c}) AS w_{c}", VITALS) + " FROM visits)")
sql("scale_minmax", "SELECT visit_id, " + ", ".join(r(f"({c} - m_{c}) / w_{c}", c) for c in VITALS) + " FROM visits, sc",
    "sc AS (SELECT " + comma("min({c}) AS m_{c}, max({c}) - min({c}) AS w_{c}", VITALS) + " FROM visits)")
sql("scalable_columns", "SELECT feature FROM (" + union(
    "SELECT '{c}' AS feature, count(DISTINCT {c}) AS u FROM visits", MODEL_FEATURES) + """ UNION ALL
    SELECT 'by_ambulance', count(DISTINCT arrival_mode = 'F') FROM visits UNION ALL SELECT 'site', 1) WHERE u > 2""")
_HR = "CASE WHEN hr <= 40 THEN 3 WHEN hr <= 50 THEN 2 WHEN hr <= 100 THEN 0 WHEN hr <= 110 THEN 1 WHEN hr <= 130 THEN 2 WHEN hr > 130 THEN 3 ELSE 0 END"
_SBP = "CASE WHEN sbp <= 70 THEN 3 WHEN sbp <= 80 THEN 2 WHEN sbp <= 100 THEN 1 WHEN sbp <= 199 THEN 0 WHEN sbp > 199 THEN 2 ELSE 0 END"
_SPO2 = "CASE WHEN spo2 < 85 THEN 3 WHEN spo2 < 90 THEN 2 WHEN spo2 < 92 THEN 1 ELSE 0 END"
_TEMP = "CASE WHEN temp < 35 THEN 2 WHEN temp < 36 THEN 1 WHEN temp <= 38 THEN 0 WHEN temp <= 39 THEN 1 WHEN temp > 39 THEN 2 ELSE 0 END"
_EWS = f"""{_HR} AS hr_risk_score, {_SBP} AS sbp_risk_score, {_SPO2} AS spo2_risk_score, {_TEMP} AS temp_risk_score,
    {_HR} + {_SBP} + {_SPO2} + {_TEMP} AS clinical_risk_score"""
sql("early_warning_score", f"SELECT visit_id, {_EWS} FROM visits")
_SI = "si AS (SELECT visit_id AS sid, CASE WHEN sbp <> 0 AND hr / sbp > 5 THEN 5e0 WHEN sbp <> 0 THEN hr / sbp END AS x FROM visits)"
_SI_COLS = f"""{r("coalesce(x, (SELECT median(x) FROM si))", "shock_index")},
    CASE WHEN coalesce(x, (SELECT median(x) FROM si)) > 0.9e0 THEN 1 ELSE 0 END AS shock_index_high"""
sql("shock_index", f"SELECT visit_id, {_SI_COLS} FROM visits JOIN si ON sid = visit_id", _SI)
_MAP = "CASE WHEN dbp IS NOT NULL AND sbp IS NOT NULL THEN least(200e0, greatest(30e0, dbp + (sbp - dbp) / 3e0)) END"
_MAP_COLS = f"""{r(_MAP, '"map"')}, CASE WHEN {_MAP} < 65 THEN 1 ELSE 0 END AS map_low"""
sql("mean_arterial_pressure", f"SELECT visit_id, {_MAP_COLS} FROM visits")
_ABN = """CASE WHEN hr < 60 OR hr > 100 THEN 1 ELSE 0 END + CASE WHEN sbp < 90 OR sbp > 140 THEN 1 ELSE 0 END
    + CASE WHEN spo2 < 95 THEN 1 ELSE 0 END + CASE WHEN temp < 36 OR temp > 38 THEN 1 ELSE 0 END AS abnormal_vitals_count"""
sql("abnormal_vitals", f"SELECT visit_id, {_ABN} FROM visits")
_PAIN = """CASE WHEN try_cast(pain_raw AS DOUBLE) >= 7 THEN 1 ELSE 0 END AS severe_pain,
    CASE WHEN try_cast(pain_raw AS DOUBLE) = 0 THEN 1 ELSE 0 END AS no_pain"""
sql("pain_flags", f"SELECT visit_id, {_PAIN} FROM visits")
sql("clinical_features", f"""SELECT visit_id, try_cast(pain_raw AS DOUBLE) AS pain, {_EWS}, {_SI_COLS}, {_MAP_COLS},
    {_BAND} AS age_category, CASE WHEN age >= 65 THEN 1 ELSE 0 END AS elderly_flag, {_ABN}, {_PAIN}
    FROM visits JOIN si ON sid = visit_id""", _SI)
_LONG = "lf AS (" + union("SELECT '{c}' AS feature, triage AS y, CAST({c} AS DOUBLE) AS x FROM visits WHERE {c} IS NOT NULL",
                          MODEL_FEATURES) + ")"
_ANOVA = f"""{_LONG}, gm AS (SELECT feature, avg(x) AS g, count(*) AS n, count(DISTINCT y) AS k FROM lf GROUP BY feature),
    cm AS (SELECT feature, y, avg(x) AS m, count(*) AS c FROM lf GROUP BY feature, y),
    bt AS (SELECT feature, sum(c * (m - g) * (m - g)) AS b FROM cm JOIN gm USING (feature) GROUP BY feature),
    wt AS (SELECT feature, sum((x - m) * (x - m)) AS w FROM lf JOIN cm USING (feature, y) GROUP BY feature),
    fs AS (SELECT feature, (b / (k - 1)) / (w / (n - k)) AS f_score, k - 1 AS df_between, n - k AS df_within
      FROM bt JOIN wt USING (feature) JOIN gm USING (feature))"""
sql("anova_f", f"SELECT feature, {r('f_score', 'f_score')}, df_between, df_within FROM fs", _ANOVA)
_EDGES = " UNION ALL ".join(f"SELECT '{c}' AS feature, unnest(list_distinct(quantile_cont({c}, "
                            f"[{', '.join(str(i / 10) for i in range(1, 10))}]))) AS e FROM visits" for c in MODEL_FEATURES)
_MI = f"""ed AS ({_EDGES}), el AS (SELECT feature, list(e) AS es FROM ed GROUP BY feature),
    bn AS (SELECT feature, y, len(list_filter(es, lambda e: x > e)) AS bin FROM lf JOIN el USING (feature)),
    jt AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM bn GROUP BY ALL),
    ms AS (SELECT feature, sum(n / t * ln(n * t / (b * c))) AS mi_score FROM (
      SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b,
        sum(n) OVER (PARTITION BY feature, y) AS c FROM jt) GROUP BY feature)"""
sql("mutual_info", f"SELECT feature, {r('mi_score', 'mi_score')} FROM ms", f"{_LONG}, {_MI}")
sql("feature_relevance", f"""SELECT feature, {r('f_score', 'f_score')}, {r('mi_score', 'mi_score')}, {r('fn', 'f_norm')},
    {r('mn', 'mi_norm')}, {r('(fn + mn) / 2', 'combined')} FROM (
      SELECT *, (f_score - min(f_score) OVER ()) / (max(f_score) OVER () - min(f_score) OVER ()) AS fn,
        (mi_score - min(mi_score) OVER ()) / (max(mi_score) OVER () - min(mi_score) OVER ()) AS mn
      FROM fs JOIN ms USING (feature))""", f"{_ANOVA}, {_MI}")
plain("five_number", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'min({c})', '"min"')}, {r(f'quantile_cont({c}, 0.25)', 'q1')}, "
    f"{r(f'median({c})', '"median"')}, {r(f'quantile_cont({c}, 0.75)', 'q3')}, {r(f'max({c})', '"max"')} FROM lineitem"
    for c in PRICES))

# ---- splitting, resampling, weighting -------------------------------------------------------------------

_COUNTS = "cn AS (SELECT triage AS class, count(*) AS n FROM visits GROUP BY triage)"
sql("class_distribution", f"""SELECT class, n, {r('n / CAST(sum(n) OVER () AS DOUBLE)', 'share')},
    {r('max(n) OVER () / CAST(min(n) OVER () AS DOUBLE)', 'imbalance_ratio')} FROM cn""", _COUNTS)
sql("stratified_split", "SELECT visit_id, split FROM s", _SPLIT)
sql("calibration_split", f"""SELECT visit_id, CASE WHEN rn <= floor(0.5e0 * n + 0.5e0) THEN 'select' ELSE 'calibrate' END AS split
    FROM ({ranked("(SELECT visit_id, triage FROM s WHERE split = 'validation')", 'visit_id', 'triage', 43)})""", _SPLIT)
sql("split_distribution", f"""SELECT split, triage, n, {r('n / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE)', 'share')}
    FROM (SELECT split, triage, count(*) AS n FROM s GROUP BY split, triage)""", _SPLIT)
sql("grouped_split", f"""SELECT visit_id, patient_id, split FROM visits JOIN
    ({three_way('(SELECT DISTINCT patient_id FROM visits)', 'patient_id', None)}) USING (patient_id)""")
plain("grouped_split_events", f"""SELECT event_id, user_id, split FROM events JOIN
    ({three_way('(SELECT DISTINCT user_id FROM events)', 'user_id', None)}) USING (user_id)""")
plain("temporal_split", """WITH o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM events),
    a AS (SELECT max(ts) FILTER (rn = floor(0.7e0 * n + 0.5e0)) AS e1,
      max(ts) FILTER (rn = floor((0.7e0 + 0.15e0) * n + 0.5e0)) AS e2 FROM o)
    SELECT event_id, CASE WHEN ts <= e1 THEN 'train' WHEN ts <= e2 THEN 'validation' ELSE 'test' END AS split FROM events, a""")
_TARGET = "CAST(greatest(n, floor(max(n) OVER () / {ratio})) AS BIGINT)"
sql("resample_targets", " UNION ALL ".join(
    f"SELECT class, n, {_TARGET.format(ratio=ratio)} AS target, '{name}' AS strategy FROM cn"
    for name, ratio in (("moderate", "2e0"), ("conservative", "2.5e0"), ("aggressive", "1.2e0"))), _COUNTS)

_FILLED = "fv AS MATERIALIZED (SELECT visit_id, triage, " + comma(
    "coalesce({c}, (SELECT median({c}) FROM visits)) AS {c}", NEAR) + " FROM visits)"
_D2 = " + ".join(f"(q.{c} - d.{c}) * (q.{c} - d.{c})" for c in NEAR)
_GOALS = f"{_COUNTS}, goal AS (SELECT class, n, {_TARGET.format(ratio='2e0')} AS target FROM cn)"


def _synthesis(seeds: str) -> str:
    """Quotas by hash order, five nearest rows of the class, one keyed draw per copy."""
    digest = "md5('42|' || CAST(visit_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR))"
    mixed = ", ".join(f"q.{c} + c.u * (d.{c} - q.{c}) AS {c}" for c in NEAR)
    return f"""
  sd AS ({seeds}),
  qt AS (SELECT visit_id, triage, (target - g.n) // m + CAST(rn <= (target - g.n) % m AS BIGINT) AS quota FROM (
      SELECT visit_id, triage, row_number() OVER (PARTITION BY triage ORDER BY {hash32('42', key('visit_id'))}, visit_id) AS rn,
        count(*) OVER (PARTITION BY triage) AS m FROM sd) z JOIN goal g ON g.class = triage WHERE target > g.n),
  nn AS (SELECT q.visit_id, arg_min(d.visit_id, ({_D2}, d.visit_id), 5) AS near
      FROM fv q JOIN fv d ON q.triage = d.triage AND q.visit_id <> d.visit_id
      WHERE q.visit_id IN (SELECT visit_id FROM qt WHERE quota > 0) GROUP BY q.visit_id),
  cp AS (SELECT visit_id, CAST(unnest(range(quota)) AS INTEGER) AS copy FROM qt),
  dr AS (SELECT visit_id, copy, near[1 + CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) % len(near)] AS did,
      CAST(('0x' || substr({digest}, 9, 8)) AS BIGINT) / 4294967296e0 AS u FROM cp JOIN nn USING (visit_id)),
  syn AS (SELECT q.triage, c.visit_id AS seed_id, c.copy, {mixed} FROM dr c JOIN fv q USING (visit_id)
      JOIN fv d ON d.visit_id = c.did)"""


_SMOTE = f"{_FILLED}, {_GOALS}, {_synthesis('SELECT visit_id, triage FROM fv')}"
_SYN = "SELECT triage, seed_id, copy, " + ", ".join(r(c, c) for c in NEAR) + " FROM syn"
sql("smote", _SYN, _SMOTE)
_RAISED = "(SELECT class FROM goal WHERE target > n)"
_DANGER = f"""dg AS (SELECT visit_id, triage FROM (
      SELECT q.visit_id, q.triage, arg_min(d.triage, ({_D2}, d.visit_id), 10) AS near FROM fv q
      JOIN fv d ON q.visit_id <> d.visit_id WHERE q.triage IN {_RAISED} GROUP BY q.visit_id, q.triage)
    WHERE len(list_filter(near, lambda c: c <> triage)) * 2 >= len(near)
      AND len(list_filter(near, lambda c: c <> triage)) < len(near))"""
sql("smote_borderline", _SYN, f"{_FILLED}, {_GOALS}, {_DANGER}, {_synthesis('SELECT * FROM dg')}")
sql("tomek_links", """SELECT a.visit_id AS id_a, b.visit_id AS id_b, a.triage AS class_a, b.triage AS class_b
    FROM n1 x JOIN n1 y ON x.did = y.visit_id AND y.did = x.visit_id AND x.visit_id < y.visit_id
    JOIN fv a ON a.visit_id = x.visit_id JOIN fv b ON b.visit_id = y.visit_id WHERE a.triage <> b.triage""",
    f"""{_FILLED}, n1 AS MATERIALIZED (SELECT q.visit_id, min(CAST({_D2} AS BIGINT) * 1000000000 + d.visit_id) % 1000000000 AS did
    FROM fv q JOIN fv d ON q.visit_id <> d.visit_id GROUP BY q.visit_id)""")
_ND2 = _D2.replace("q.", "a.").replace("d.", "b.")
sql("smote_tomek", "SELECT visit_id, triage, " + ", ".join(r(c, c) for c in NEAR) + """ FROM whole
    WHERE visit_id NOT IN (SELECT id_a FROM links UNION ALL SELECT id_b FROM links)""", f"""{_SMOTE},
  whole AS MATERIALIZED (SELECT visit_id, triage, {', '.join(NEAR)} FROM fv UNION ALL
    SELECT -(seed_id * ((SELECT max(target) FROM goal) + 1) + copy) - 1, triage, {', '.join(NEAR)} FROM syn),
  closest AS MATERIALIZED (SELECT a.visit_id, min({_ND2}) AS m FROM whole a JOIN whole b ON a.visit_id <> b.visit_id
    GROUP BY a.visit_id),
  first AS MATERIALIZED (SELECT a.visit_id, a.triage, min(b.visit_id) AS did FROM (SELECT * FROM whole JOIN closest
    USING (visit_id)) a JOIN whole b ON a.visit_id <> b.visit_id AND {_ND2} = a.m GROUP BY a.visit_id, a.triage),
  links AS (SELECT x.visit_id AS id_a, y.visit_id AS id_b FROM first x JOIN first y ON x.did = y.visit_id
    AND y.did = x.visit_id AND x.triage <> y.triage AND x.visit_id < y.visit_id)""")
_RES = f"{_GOALS}, tot AS (SELECT sum(n) AS sn, sum(target) AS st, max(n) AS xn, min(n) AS mn, max(target) AS xt, min(target) AS mt FROM goal)"
sql("resample_report", f"""SELECT class, n AS n_before, target AS n_after, target - n AS change,
    {r('100e0 * (target - n) / n', 'change_pct')}, {r('xn / CAST(mn AS DOUBLE)', 'ir_before')},
    {r('xt / CAST(mt AS DOUBLE)', 'ir_after')}, {r('100e0 * (st - sn) / st', 'synthetic_pct')} FROM goal, tot""", _RES)
sql("class_weights", f"""SELECT class, target AS n, {r('w', 'raw_weight')}, {r('w / avg(w) OVER ()', 'weight')} FROM (
    SELECT class, target, st / (3 * CAST(target AS DOUBLE)) AS w FROM goal, tot)""", _RES)
sql("quality_checks", """SELECT "check", status, round(value, 6) AS value FROM (
    SELECT 'synthetic_share' AS "check", CASE WHEN 100e0 * (st - sn) / st <= 25 THEN 'PASS' ELSE 'FAIL' END AS status,
      100e0 * (st - sn) / st AS value FROM tot
    UNION ALL SELECT 'imbalance_ratio', CASE WHEN abs(xt / CAST(mt AS DOUBLE) - 2) <= 0.5e0 THEN 'PASS' ELSE 'WARN' END,
      xt / CAST(mt AS DOUBLE) FROM tot
    UNION ALL SELECT 'weight_ratio', CASE WHEN xt / CAST(mt AS DOUBLE) <= 4 THEN 'PASS' ELSE 'WARN' END,
      xt / CAST(mt AS DOUBLE) FROM tot
    UNION ALL SELECT 'sampler', 'PASS', 1e0)""", _RES)
sql("stratified_kfold", f"""SELECT visit_id, CAST((rn > n // 5) AS INTEGER) + CAST((rn > 2 * n // 5) AS INTEGER)
    + CAST((rn > 3 * n // 5) AS INTEGER) + CAST((rn > 4 * n // 5) AS INTEGER) AS fold
    FROM ({ranked('visits', 'visit_id', 'triage', 42)})""")
sql("sample_n", f"SELECT visit_id, sbp, triage FROM visits ORDER BY {hash32('42', key('visit_id'))}, visit_id LIMIT 500")

# ---- models ---------------------------------------------------------------------------------------------

_VOTE = {c: f"(2e0 * {p} + 2e0 * CAST(y_pred = '{c}' AS INTEGER) + CAST(y_pred_b = '{c}' AS INTEGER)) / 5e0"
         for c, p in SCORES.items()}
sql("soft_vote", "SELECT visit_id, " + ", ".join(r(v, f'"p_{c}"') for c, v in _VOTE.items()) + """,
    CASE WHEN r >= y AND r >= g THEN 'RED' WHEN y >= g THEN 'YELLOW' ELSE 'GREEN' END AS prediction FROM (
    SELECT *, """ + ", ".join(f"{v} AS {n}" for n, v in zip("ryg", _VOTE.values(), strict=True)) + " FROM preds)")
sql("detailed_predictions", "SELECT visit_id, y_true AS true_label, y_pred AS predicted_label, y_true = y_pred AS correct, "
    + ", ".join(r(p, f'"prob_{c}"') for c, p in SCORES.items()) + " FROM preds")
sql("baseline_dummy", """SELECT visit_id, triage, (SELECT triage FROM visits GROUP BY triage ORDER BY count(*) DESC, triage
    LIMIT 1) AS prediction FROM visits""")
sql("baseline_rules", f"""SELECT visit_id, triage, CASE WHEN s >= 6 THEN 'RED' WHEN s >= 3 THEN 'YELLOW' ELSE 'GREEN' END
    AS prediction FROM (SELECT visit_id, triage, {_HR} + {_SBP} + {_SPO2} + {_TEMP} AS s FROM visits)""")

# ---- evaluation -----------------------------------------------------------------------------------------


def scored(rows: str, by: str = "") -> str:
    """CTE text: rows(by..., y, p, w) -> table ``ev`` of metrics per group."""
    g = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    join_class = f"USING ({g}c)"
    return f"""ev_in AS ({rows}),
    ev_c AS (SELECT {g}c, max(t) AS t, max(q) AS q, max(h) AS h FROM (
        SELECT {g}y AS c, sum(w) AS t, 0 AS q, sum(CASE WHEN y = p THEN w ELSE 0 END) AS h FROM ev_in GROUP BY {g}y
        UNION ALL SELECT {g}p, 0, sum(w), 0 FROM ev_in GROUP BY {g}p) GROUP BY {g}c),
    ev_n AS (SELECT {g}sum(w) AS n, sum(CASE WHEN y = p THEN w ELSE 0 END) AS right_n FROM ev_in {group}),
    ev_f AS (SELECT *, CASE WHEN t > 0 THEN h / CAST(t AS DOUBLE) ELSE 0 END AS rec,
        CASE WHEN q > 0 THEN h / CAST(q AS DOUBLE) ELSE 0 END AS prec,
        CASE WHEN t + q > 0 THEN 2e0 * h / (t + q) ELSE 0 END AS f1 FROM ev_c),
    ev AS (SELECT {g}CAST(max(n) AS BIGINT) AS n, max(right_n) / CAST(max(n) AS DOUBLE) AS accuracy,
        avg(CASE WHEN t > 0 THEN rec END) AS balanced_accuracy, avg(f1) AS macro_f1, sum(f1 * t) / max(n) AS weighted_f1,
        (CAST(max(right_n) AS DOUBLE) * max(n) - sum(CAST(t AS DOUBLE) * q))
          / (sqrt(CAST(max(n) AS DOUBLE) * max(n) - sum(CAST(q AS DOUBLE) * q))
             * sqrt(CAST(max(n) AS DOUBLE) * max(n) - sum(CAST(t AS DOUBLE) * t))) AS mcc
        FROM ev_f JOIN ev_n {using} {group})"""


_ONE = scored("SELECT y_true AS y, y_pred AS p, 1 AS w FROM preds")
sql("confusion_matrix", f"""SELECT a.c AS y, b.c AS p, count(z.visit_id) AS n,
    {r('count(z.visit_id) / CAST(sum(count(z.visit_id)) OVER (PARTITION BY a.c) AS DOUBLE)', 'row_share')}
    FROM (VALUES ('GREEN'), ('RED'), ('YELLOW')) a(c) CROSS JOIN (VALUES ('GREEN'), ('RED'), ('YELLOW')) b(c)
    LEFT JOIN preds z ON z.y_true = a.c AND z.y_pred = b.c GROUP BY a.c, b.c""")
sql("balanced_accuracy", f"SELECT {r('accuracy', 'accuracy')}, {r('balanced_accuracy', 'balanced_accuracy')} FROM ev", _ONE)
sql("f1_scores", f"SELECT {r('macro_f1', 'macro_f1')}, {r('weighted_f1', 'weighted_f1')} FROM ev", _ONE)
sql("mcc", f"SELECT {r('mcc', 'mcc')} FROM ev", _ONE)
_AUC = "au AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS class, (sum(rk) FILTER (hit) - p * (p + 1) / 2e0) / (p * (m - p)) AS auc
    FROM (SELECT y_true = '{c}' AS hit, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2e0 AS rk,
      CAST(count(*) FILTER (y_true = '{c}') OVER () AS DOUBLE) AS p, count(*) OVER () AS m FROM preds) GROUP BY p, m"""
                                      for c, s in SCORES.items()) + ")"
sql("classification_report", f"""SELECT c AS class, {r('prec', 'precision')}, {r('rec', 'recall')}, {r('f1', 'f1')},
    CAST(t AS BIGINT) AS support, {r('auc', 'auc')} FROM ev_f JOIN au ON au.class = c""", f"{_ONE}, {_AUC}")
_PSPLIT = f"ps AS (SELECT y_true, y_pred, y_pred_b, p_red, p_yellow, p_green, split FROM ({three_way('preds', 'visit_id', 'y_true')}))"
_G = ("accuracy", "balanced_accuracy", "macro_f1")
sql("overfit_gaps", "SELECT " + ", ".join(r(f"{a}.{m}", f"{n}_{m}") for a, n in (("t", "train"), ("v", "validation")) for m in _G)
    + f""", {r('t.accuracy - v.accuracy', 'accuracy_gap')}, {r('t.balanced_accuracy - v.balanced_accuracy', 'balanced_gap')},
    CASE WHEN t.accuracy - v.accuracy < 0.05e0 THEN 'GOOD' WHEN t.accuracy - v.accuracy < 0.07e0 THEN 'OK' ELSE 'HIGH' END AS band
    FROM (SELECT * FROM ev WHERE split = 'train') t, (SELECT * FROM ev WHERE split = 'validation') v""",
    f"{_PSPLIT}, {scored('SELECT split, y_true AS y, y_pred AS p, 1 AS w FROM ps', 'split')}")
_CAL_HALF = f"""half AS MATERIALIZED (SELECT *, CASE WHEN rn <= floor(0.5e0 * n + 0.5e0) THEN 'select' ELSE 'calibrate' END
    AS split FROM ({ranked('preds', 'visit_id', 'y_true', 43)}))"""


def _isotonic(c: str, s: str) -> str:
    """Least-squares monotone steps by the max-min formula, interpolated between fitted scores."""
    return f"""d_{c} AS (SELECT x, row_number() OVER w AS i, sum(h) OVER w AS ch, sum(n) OVER w AS cn, h, n FROM (
        SELECT {s} AS x, CAST(count(*) FILTER (y_true = '{c}') AS DOUBLE) AS h, count(*) AS n FROM half
        WHERE split = 'calibrate' GROUP BY {s}) WINDOW w AS (ORDER BY x)),
      m_{c} AS (SELECT j.i AS j, i.i AS i, min((k.ch - j.ch + j.h) / (k.cn - j.cn + j.n)) AS lowest
        FROM d_{c} j JOIN d_{c} i ON j.i <= i.i JOIN d_{c} k ON k.i >= i.i GROUP BY j.i, i.i),
      g_{c} AS (SELECT x, g FROM d_{c} JOIN (SELECT i, max(lowest) AS g FROM m_{c} GROUP BY i) USING (i)),
      f_{c} AS (SELECT s, coalesce(CASE WHEN b.x = a.x THEN a.g ELSE a.g + (b.g - a.g) * (s - a.x) / (b.x - a.x) END, a.g, b.g) AS f
        FROM (SELECT s, (SELECT max(x) FROM g_{c} WHERE x <= s) AS lo, (SELECT min(x) FROM g_{c} WHERE x >= s) AS hi
          FROM (SELECT DISTINCT {s} AS s FROM half)) LEFT JOIN g_{c} a ON a.x = lo LEFT JOIN g_{c} b ON b.x = hi)"""


_CAL_SUM = "(f_RED.f + f_YELLOW.f + f_GREEN.f)"
sql("isotonic_calibration", "SELECT visit_id, split, " + ", ".join(r(
    f"CASE WHEN {_CAL_SUM} > 0 THEN f_{c}.f / {_CAL_SUM} ELSE 1 / 3e0 END", f'"cal_{c}"') for c in SCORES) + " FROM half "
    + " ".join(f"JOIN f_{c} ON f_{c}.s = half.{s}" for c, s in SCORES.items()),
    _CAL_HALF + ", " + ", ".join(_isotonic(c, s) for c, s in SCORES.items()))
_SOFT = "CASE WHEN p_red >= p_yellow AND p_red >= p_green THEN 'RED' WHEN p_yellow >= p_green THEN 'YELLOW' ELSE 'GREEN' END"
_COMPARE = f"""{_PSPLIT}, {scored(f'''SELECT model, split, y, p, 1 AS w FROM (
    SELECT 'A' AS model, split, y_true AS y, y_pred AS p FROM ps UNION ALL SELECT 'B', split, y_true, y_pred_b FROM ps
    UNION ALL SELECT 'C', split, y_true, {_SOFT} FROM ps) WHERE split <> 'test' ''', 'model, split')},
    cmp AS (SELECT v.model, v.balanced_accuracy AS val_balanced, v.macro_f1 AS val_f1, t.accuracy - v.accuracy AS acc_gap,
      0.7e0 * v.balanced_accuracy + 0.3e0 * (1 - least(greatest(t.accuracy - v.accuracy, 0), 0.15e0) / 0.15e0) AS selection_score
      FROM ev v JOIN ev t ON t.model = v.model AND t.split = 'train' WHERE v.split = 'validation')"""
_COMPARED = ", ".join(r(c, c) for c in ("val_balanced", "val_f1", "acc_gap", "selection_score"))
sql("model_comparison", f"SELECT model, {_COMPARED} FROM cmp", _COMPARE)
sql("model_selection", f"SELECT model, {_COMPARED} FROM cmp ORDER BY cmp.selection_score DESC, model LIMIT 1", _COMPARE)
sql("roc_auc", f"SELECT class, {r('auc', 'auc')} FROM au", _AUC)
sql("roc_auc_macro", f"SELECT {r('avg(auc)', 'macro_auc')} FROM au", _AUC)
_STEPS = "st AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS class, {s} AS x, count(*) FILTER (y_true = '{c}') AS pos,
    count(*) FILTER (y_true <> '{c}') AS neg FROM preds GROUP BY {s}""" for c, s in SCORES.items()) + """),
    rc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, CAST(sum(pos) OVER (PARTITION BY class) AS DOUBLE) AS np,
      CAST(sum(neg) OVER (PARTITION BY class) AS DOUBLE) AS nn, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2,
      row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY class ORDER BY x DESC))"""
_ENDS = "(VALUES ('RED'), ('YELLOW'), ('GREEN')) u(class)"
sql("roc_curve", f"""SELECT class, {r('x', 'threshold')}, {r('fp / nn', 'fpr')}, {r('tp / np', 'tpr')} FROM rc
    WHERE rn = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
    UNION ALL SELECT class, NULL, 0e0, 0e0 FROM {_ENDS}""", _STEPS)
sql("pr_curve", f"""SELECT class, {r('x', 'threshold')}, {r('tp / CAST(tp + fp AS DOUBLE)', 'precision')},
    {r('tp / np', 'recall')} FROM rc UNION ALL SELECT class, NULL, 1e0, 0e0 FROM {_ENDS}""", _STEPS)
sql("average_precision", f"""SELECT class, {r('sum(pos / np * tp / (tp + fp))', 'average_precision')} FROM rc GROUP BY class""",
    _STEPS)
_PROB = "pl AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS class, {s} AS x, CAST(y_true = '{c}' AS INTEGER) AS hit FROM preds" for c, s in SCORES.items()) + ")"
sql("calibration_curve", f"""SELECT class, CAST(bin AS INTEGER) AS bin, {r('avg(x)', 'mean_predicted')},
    {r('avg(hit)', 'fraction_positive')}, count(*) AS n FROM (SELECT *, greatest(ceil(x * 10), 1) - 1 AS bin FROM pl)
    GROUP BY class, bin""", _PROB)
sql("brier", f"SELECT class, {r('avg((x - hit) * (x - hit))', 'brier')} FROM pl GROUP BY class", _PROB)
sql("crosstab_margins", """SELECT coalesce(y_true, 'All') AS y_true, coalesce(y_pred, 'All') AS y_pred, count(*) AS n
    FROM preds GROUP BY CUBE (y_true, y_pred)""")
sql("misclass_patterns", f"""SELECT y_true, y_pred, n, {r('100e0 * n / t', 'pct')} FROM (
    SELECT y_true, y_pred, count(*) AS n, (SELECT count(*) FROM preds) AS t FROM preds WHERE y_true <> y_pred
    GROUP BY y_true, y_pred)""")
sql("triage_error_counts", """SELECT kind, count(risk) AS n FROM (VALUES ('critical', 'critical'), ('important', 'important'),
    ('over_triage', 'over_triage'), ('under_triage', 'critical'), ('under_triage', 'important')) k(kind, part)
    LEFT JOIN rk ON risk = part GROUP BY kind""", f"rk AS (SELECT {_RISK} AS risk FROM preds)")

# ---- explanation ----------------------------------------------------------------------------------------

_SLOPES = {"RED": (0.02, -0.01, -0.05), "YELLOW": (0.01, 0.005, -0.02), "GREEN": (-0.03, 0.005, 0.07)}
_PHI = "mn AS (SELECT avg(hr) AS hr, avg(sbp) AS sbp, avg(spo2) AS spo2 FROM visits), phis AS (" + " UNION ALL ".join(
    f"SELECT visit_id, '{c}' AS class, '{f}' AS feature, coalesce((visits.{f} - mn.{f}) * {b}e0, 0e0) AS x FROM visits, mn"
    for c, bs in _SLOPES.items() for f, b in zip(("hr", "sbp", "spo2"), bs, strict=True)) + ")"
sql("shapley_linear", f"SELECT visit_id, class, feature, {r('x', 'phi')} FROM phis", _PHI)
sql("shapley_global", f"SELECT feature, {r('avg(abs(x))', 'importance')} FROM phis GROUP BY feature", _PHI)
sql("shapley_by_class", f"SELECT class, feature, {r('avg(abs(x))', 'importance')} FROM phis GROUP BY class, feature", _PHI)

# ---- study ----------------------------------------------------------------------------------------------

_STEPS_P = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)
_BLOCK = "md5('42|' || CAST(rep // 4 AS VARCHAR) || '|' || CAST(visit_id AS VARCHAR))"
_REPS = f"""bw AS (SELECT rep, y_true AS y, y_pred AS p, {' + '.join(f'CAST(u >= {s}e0 AS INTEGER)' for s in _STEPS_P)} AS w
    FROM (SELECT *, CAST(('0x' || substr({_BLOCK}, 1 + 8 * (rep % 4), 8)) AS BIGINT) / 4294967296e0 AS u
      FROM preds, range(1000) t(rep)))"""
sql("bootstrap_ci", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, {r(f'avg({m})', 'mean')}, {r(f'quantile_cont({m}, 0.025)', 'low')},
    {r(f'quantile_cont({m}, 0.5)', '"median"')}, {r(f'quantile_cont({m}, 0.975)', 'high')} FROM ev""" for m in _G) + ")",
    f"{_REPS}, {scored('SELECT rep, y, p, w FROM bw WHERE w > 0', 'rep')}")
sql("mcnemar", f"""SELECT both_right, only_a, only_b, both_wrong,
    {r('(abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / CAST(only_a + only_b AS DOUBLE)', 'statistic')} FROM (
    SELECT count(*) FILTER (y_pred = y_true AND y_pred_b = y_true) AS both_right,
      count(*) FILTER (y_pred = y_true AND y_pred_b <> y_true) AS only_a,
      count(*) FILTER (y_pred <> y_true AND y_pred_b = y_true) AS only_b,
      count(*) FILTER (y_pred <> y_true AND y_pred_b <> y_true) AS both_wrong FROM preds)""")
sql("subgroup_metrics", f"""SELECT dim, value, n, {r('accuracy', 'accuracy')}, {r('balanced_accuracy', 'balanced_accuracy')},
    {r('macro_f1', 'macro_f1')}, {r('max(accuracy) OVER (PARTITION BY dim) - min(accuracy) OVER (PARTITION BY dim)', 'max_gap')}
    FROM ev""", scored(f"""SELECT 'age' AS dim, coalesce({_BAND}, '(missing)') AS value, y_true AS y, y_pred AS p, 1 AS w FROM preds
    UNION ALL SELECT 'arrival', arrival_mode, y_true, y_pred, 1 FROM preds
    UNION ALL SELECT 'ambulance', CASE WHEN arrival_mode = 'F' THEN 'true' ELSE 'false' END, y_true, y_pred, 1 FROM preds""",
                      "dim, value"))
sql("learning_curve_sizes", f"""SELECT CAST(step AS INTEGER) AS step, count(*) AS n, CAST(sum(visit_id) AS BIGINT) AS key_sum FROM (
    SELECT visit_id, {' + '.join(f'CAST(rn > floor({i / 10}e0 * n + 0.5e0) AS INTEGER)' for i in range(1, 10))} AS step
    FROM ({ranked('visits', 'visit_id', None, 42)})) GROUP BY step""")


# ---- numeric and missing classes, dependent columns, failed sampling ------------------------------------

plain("stratified_split_labels", f"""SELECT doc_id, toxic, split FROM ({three_way(
    '(SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN toxic END AS toxic FROM labels)', 'doc_id', 'toxic')})""")
plain("stratified_split_lines", f"""SELECT l_orderkey, lines, split FROM ({three_way(
    '(SELECT l_orderkey, max(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey)', 'l_orderkey', 'lines')})""")
plain("vif_dependent", f"""WITH p AS (
  SELECT sum(a*a) AS aa, sum(b*b) AS bb, sum(c*c) AS cc, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*c) AS bc FROM (
    SELECT CAST(l_extendedprice AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c FROM lineitem)),
  q AS (SELECT ab / sqrt(aa*bb) AS ab, ac / sqrt(aa*cc) AS ac, bc / sqrt(bb*cc) AS bc FROM p),
  dt AS (SELECT *, 1 + 2*ab*ac*bc - ab*ab - ac*ac - bc*bc AS det FROM q),
  v AS (SELECT 'l_extendedprice' AS feature, (1 - bc*bc) / det AS v FROM dt UNION ALL SELECT 'l_discount', (1 - ab*ab) / det FROM dt)
SELECT feature, {r('v', 'vif')}, CASE WHEN v <= 5 THEN 'Low (<5)' WHEN v <= 10 THEN 'Moderate (5-10)' WHEN v <= 100 THEN 'High (10-100)'
  ELSE 'Severe (>100)' END AS vif_category FROM v""")
plain("drop_collinear_table", """SELECT round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS l_extendedprice,
    round(sum(2 * CAST(l_quantity AS DOUBLE)), 2) AS twice, round(sum(CAST(l_discount AS DOUBLE)), 2) AS l_discount FROM lineitem""")
_FEW = """few AS (SELECT triage, count(*) AS n FROM visits GROUP BY triage),
    f AS (SELECT max(n) / CAST(min(n) AS DOUBLE) AS ir FROM few)"""
sql("quality_checks_failed", """SELECT * FROM (
    SELECT 'synthetic_share' AS "check", 'PASS' AS status, 0e0 AS value
    UNION ALL SELECT 'imbalance_ratio', CASE WHEN abs(ir - 2) <= 0.5e0 THEN 'PASS' ELSE 'WARN' END, round(ir, 6) FROM f
    UNION ALL SELECT 'weight_ratio', CASE WHEN ir <= 4 THEN 'PASS' ELSE 'WARN' END, round(ir, 6) FROM f
    UNION ALL SELECT 'sampler', 'FAIL', 0e0)""", _FEW)
sql("resample_report_vanished", f"""SELECT class, n_before, n_after, n_after - n_before AS change,
    {r('CASE WHEN n_before = 0 THEN 0e0 ELSE 100e0 * (n_after - n_before) / n_before END', 'change_pct')},
    CAST(NULL AS DOUBLE) AS ir_before, CAST(NULL AS DOUBLE) AS ir_after,
    {r('100e0 * sum(n_after - n_before) OVER () / sum(n_after) OVER ()', 'synthetic_pct')} FROM (
    SELECT triage AS class, count(*) FILTER (triage <> 'GREEN') AS n_before, count(*) FILTER (triage <> 'RED') AS n_after
    FROM visits GROUP BY triage)""")
for _first, _second in (("train", "test"), ("validation", "test")):
    sql(f"overfit_gaps_{_first}_{_second}", "SELECT " + ", ".join(
        r(f"{a}.{m}", f"{n}_{m}") for a, n in (("t", _first), ("v", _second)) for m in _G)
        + f""", {r('t.accuracy - v.accuracy', 'accuracy_gap')}, {r('t.balanced_accuracy - v.balanced_accuracy', 'balanced_gap')},
        CASE WHEN t.accuracy - v.accuracy < 0.05e0 THEN 'GOOD' WHEN t.accuracy - v.accuracy < 0.07e0 THEN 'OK' ELSE 'HIGH' END AS band
        FROM (SELECT * FROM ev WHERE split = '{_first}') t, (SELECT * FROM ev WHERE split = '{_second}') v""",
        f"{_PSPLIT}, {scored('SELECT split, y_true AS y, y_pred AS p, 1 AS w FROM ps', 'split')}")

# ---- handoffs: what is read back is what was written ----------------------------------------------------

_LINES = """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    CAST(l_quantity AS DOUBLE) AS l_quantity, l_returnflag FROM lineitem"""
plain("stage_round_trip", _LINES)
plain("scan_csv", _LINES)
ORACLES["report_csv"] = ORACLES["five_number"]
sql("report_json", "SELECT visit_id, sbp, CASE WHEN visit_id % 3 = 2 THEN sbp END AS x FROM visits")
sql("state_round_trip", "SELECT visit_id, " + ", ".join(r(f"coalesce({c}, (SELECT median({c}) FROM visits))", c) for c in NEAR) + " FROM visits")
ORACLES["attribution_sink"] = ORACLES["shapley_linear"]
sql("model_round_trip", "SELECT split, count(*) AS n, count(*) AS agree, count(*) AS sum_to_one FROM s GROUP BY split", _SPLIT)

# ---- what must hold for trained and iterated results ----------------------------------------------------

for _name in ("impute_chained_rounds", "impute_chained_forest", "impute_forest_category", "impute_auto"):
    sql(f"{_name}_checked", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS gaps, count(*) AS kept FROM visits")
for _name in ("boosted_trees", "random_forest", "logistic"):
    sql(f"{_name}_checked", "SELECT split, count(*) AS n, count(*) AS sum_to_one, TRUE AS learned FROM s GROUP BY split", _SPLIT)
plain("grid_search_cv_checked", """SELECT CAST(row_number() OVER (ORDER BY n, d, l, r <> 'sqrt', s) - 1 AS INTEGER) AS setting,
    '{''n_estimators'': ' || n || ', ''max_depth'': ' || d || ', ''min_samples_leaf'': ' || l || ', ''max_features'': ''' || r ||
    ''', ''max_samples'': ' || s || '}' AS params, TRUE AS inside, TRUE AS learned, TRUE AS refit_is_best
    FROM (VALUES (150), (200), (250)) a(n), (VALUES (15), (18), (20), (30)) b(d), (VALUES (5), (8), (10)) c(l),
         (VALUES ('sqrt'), ('log2')) e(r), (VALUES (0.7), (0.8), (0.9)) f(s)""")
plain("feature_importance_checked", """SELECT source, CAST(7 AS BIGINT) AS features, 1e0 AS total
    FROM (VALUES ('boosted'), ('ensemble'), ('forest'), ('logistic')) t(source)""")
sql("baseline_learned_checked", """SELECT model, split, count(*) AS n, CAST(1 AS BIGINT) AS inside
    FROM s, (VALUES ('logistic'), ('tree')) m(model) GROUP BY model, split""", _SPLIT)
sql("shapley_sampled_checked", """SELECT count(*) AS visits, 7 * count(*) AS cells, 21 * count(*) AS n, 7 * count(*) AS "cancel"
    FROM s WHERE split = 'test'""", _SPLIT)
sql("bootstrap_ci_table_checked", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round({m}, 6) AS value, TRUE AS inside, TRUE AS ordered FROM ev" for m in _G), _ONE)
plain("learning_curve_checked", "SELECT CAST(10 AS BIGINT) AS steps, CAST(10 AS BIGINT) AS inside, CAST(10 AS BIGINT) AS spreads, TRUE AS rises")
plain("ablation_checked", """SELECT dropped, CAST(1 AS BIGINT) AS inside, CAST(1 AS BIGINT) AS adds_up
    FROM (VALUES ('(none)'), ('circulation'), ('breathing'), ('general')) t(dropped)""")
sql("temporal_validation_checked", """SELECT split, count(*) AS n, CAST(1 AS BIGINT) AS inside FROM (
    SELECT CASE WHEN arrival_ts <= e1 THEN 'train' WHEN arrival_ts <= e2 THEN 'validation' ELSE 'test' END AS split FROM visits,
      (SELECT max(ts) FILTER (rn = floor(0.7e0 * n + 0.5e0)) AS e1, max(ts) FILTER (rn = floor((0.7e0 + 0.15e0) * n + 0.5e0)) AS e2 FROM (
        SELECT arrival_ts AS ts, row_number() OVER (ORDER BY arrival_ts) AS rn, count(*) OVER () AS n FROM visits))) GROUP BY split""")

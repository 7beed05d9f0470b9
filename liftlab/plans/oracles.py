"""Independent SQL statements of the registered queries (DuckDB dialect).

Each statement recomputes the experiment table from the driver's tables
(``with_overlay``) and then the operator in plain SQL. They exist to check
the Spark operators; the library never runs them.
"""

from __future__ import annotations

import math

from liftlab.functions.normal import LOG_TINY, log_sf_sql, num, ppf, sf_sql
from liftlab.functions.rounding import sround_sql
from liftlab.sources.overlay import with_overlay

Z975 = ppf(0.975)


def R(expr: str, name: str) -> str:
    """Round a double output like the Spark side does."""
    return f"{sround_sql(f'CAST(({expr}) AS DOUBLE)')} AS {name}"


def _pop_cte(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""pop AS (
  SELECT {sel}COUNT(*) AS total_count, CAST(SUM(treatment) AS BIGINT) AS treatment_count,
         COUNT(*) - CAST(SUM(treatment) AS BIGINT) AS control_count,
         CAST(SUM(visit) AS BIGINT) AS visit_total,
         CAST(SUM(visit * treatment) AS BIGINT) AS visit_treatment,
         CAST(SUM(visit * (1 - treatment)) AS BIGINT) AS visit_control,
         CAST(SUM(conversion) AS BIGINT) AS conversion_total,
         CAST(SUM(conversion * treatment) AS BIGINT) AS conversion_treatment,
         CAST(SUM(conversion * (1 - treatment)) AS BIGINT) AS conversion_control,
         CAST(SUM(exposure) AS BIGINT) AS exposure_total,
         CAST(SUM(exposure * treatment) AS BIGINT) AS exposure_treatment,
         CAST(SUM(exposure * (1 - treatment)) AS BIGINT) AS exposure_control
  FROM exp {grp}
)"""


def _counts_cte(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    parts = [f"SELECT {sel}'{o}' AS outcome, total_count, treatment_count, control_count, "
             f"{o}_total AS total_positive, {o}_treatment AS treatment_positive, "
             f"{o}_control AS control_positive FROM pop" for o in ("visit", "conversion")]
    return "counts AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


def population_summary() -> str:
    return with_overlay(f""", {_pop_cte()}
SELECT total_count, treatment_count, control_count, visit_total, visit_treatment,
       visit_control, conversion_total, conversion_treatment, conversion_control,
       exposure_total, exposure_treatment, exposure_control FROM pop""")


def outcome_descriptives() -> str:
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()}
SELECT outcome, total_count AS overall_count, total_positive AS overall_positive,
       {R('total_positive / total_count', 'overall_rate')},
       treatment_count, treatment_positive,
       {R('treatment_positive / treatment_count', 'treatment_rate')},
       control_count, control_positive,
       {R('control_positive / control_count', 'control_rate')}
FROM counts""")


def exposure_diagnostics() -> str:
    return with_overlay(f""", {_pop_cte()}
SELECT exposure_treatment AS treated_positive, treatment_count AS treated_count,
       {R('exposure_treatment / treatment_count', 'treated_exposure_rate')},
       exposure_control AS control_positive, control_count,
       {R('exposure_control / control_count', 'control_exposure_rate')},
       exposure_control = 0 AS control_has_no_exposure,
       TRUE AS post_assignment_variable, FALSE AS causal_effect_estimated
FROM pop""")


def allocation_audit(p: float = 0.85) -> str:
    z = f"(treatment_count - total_count * {num(p)}) / SQRT(total_count * {num(p * (1 - p))})"
    return with_overlay(f""", {_pop_cte()},
a AS (SELECT *, {z} AS z, ABS({z}) AS absz,
             treatment_count / total_count AS obs FROM pop)
SELECT total_count AS total_observations, treatment_count AS treatment_observations,
       control_count AS control_observations,
       {R('obs', 'treatment_proportion')}, {R(f'{num(1.0)} - obs', 'control_proportion')},
       {R(num(p), 'expected_treatment_proportion')},
       {R(f'obs - {num(p)}', 'proportion_difference')},
       {R(f'(obs - {num(p)}) * 100', 'difference_percentage_points')},
       {R(f'treatment_count - total_count * {num(p)}', 'count_difference_from_expected')},
       {R('z', 'z_statistic')},
       {R(f'LEAST({num(1.0)}, {num(2.0)} * {sf_sql("absz")})', 'p_value')}
FROM a""")


def _effects_select(keys: str, alpha: float = 0.05) -> str:
    zc = num(ppf(1 - alpha / 2))
    return f"""r AS (
  SELECT *, treatment_positive / treatment_count AS tr,
         control_positive / control_count AS cr FROM counts
), s AS (
  SELECT *, tr - cr AS rd,
         SQRT(tr * (1 - tr) / treatment_count + cr * (1 - cr) / control_count) AS se,
         (treatment_positive + control_positive) / (treatment_count + control_count) AS pooled
  FROM r
), t AS (
  SELECT *, SQRT(pooled * (1 - pooled) * ({num(1.0)} / treatment_count
                                             + {num(1.0)} / control_count)) AS null_se
  FROM s
), u AS (
  SELECT *, CASE WHEN null_se > 0 THEN rd / null_se WHEN rd = 0 THEN {num(0.0)}
                 ELSE {num(float('inf'))} END AS z,
         CASE WHEN treatment_positive > 0 AND control_positive > 0 THEN tr / cr END AS rr,
         CASE WHEN treatment_positive > 0 AND control_positive > 0 THEN
           SQRT({num(1.0)} / treatment_positive - {num(1.0)} / treatment_count
                + {num(1.0)} / control_positive - {num(1.0)} / control_count) END AS lse
  FROM t
), v AS (
  SELECT *, ABS(z) AS absz FROM u
), w AS (
  SELECT *, LEAST({num(0.0)}, {num(math.log(2.0))} + {log_sf_sql('absz')}) AS lp FROM v
)
SELECT {keys}treatment_count, treatment_positive, {R('tr', 'treatment_rate')},
       control_count, control_positive, {R('cr', 'control_rate')},
       {R(num(1 - alpha), 'confidence_level')},
       {R('rd', 'absolute_risk_difference')},
       {R(f'GREATEST({num(-1.0)}, rd - {zc} * se)', 'absolute_risk_difference_ci_lower')},
       {R(f'LEAST({num(1.0)}, rd + {zc} * se)', 'absolute_risk_difference_ci_upper')},
       {R('se', 'standard_error')}, {R('z', 'z_statistic')},
       {R('rr', 'relative_risk')},
       {R(f'EXP(LN(rr) - {zc} * lse)', 'relative_risk_ci_lower')},
       {R(f'EXP(LN(rr) + {zc} * lse)', 'relative_risk_ci_upper')},
       {R('rr - 1', 'relative_lift')}, {R('(rr - 1) * 100', 'relative_lift_percent')},
       {R('rd * 100000', 'incremental_outcomes_per_100000_assigned')},
       {R('lp', 'log_p_value')},
       {R(f'CASE WHEN lp > {num(LOG_TINY)} THEN EXP(lp) ELSE {num(0.0)} END', 'p_value')},
       {R(f'lp / {num(math.log(10.0))}', 'log10_p_value')}
FROM w"""


def itt_effects() -> str:
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()}, {_effects_select('outcome, ')}""")


def itt_effects_by_segment() -> str:
    return with_overlay(
        f""", {_pop_cte('f4')}, {_counts_cte('f4')}, {_effects_select('f4, outcome, ')}""")


def transformed_outcome_summary(p: float = 0.85) -> str:
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()}
SELECT outcome, total_count AS observations, treatment_positive, control_positive,
       {R(num(p), 'propensity')},
       {R(f'(treatment_positive / {num(p)} - control_positive / {num(1 - p)}) / total_count',
          'mean_transformed_outcome')}
FROM counts""")


def _newcombe_select(keys: str, tp: str, tn: str, cp: str, cn: str) -> str:
    """Select list of the Newcombe hybrid-score table over count columns."""
    z = Z975
    z2 = z * z

    def wilson(x: str, n: str, sign: str) -> str:
        return (f"(({x} + {num(z2 / 2)}) / ({n} + {num(z2)}) {sign} {num(z)} * "
                f"SQRT({x} * ({n} - {x}) / {n} + {num(z2 / 4)}) / ({n} + {num(z2)}))")

    p1, p0 = f"({tp} / {tn})", f"({cp} / {cn})"
    d = f"({p1} - {p0})"
    lo = f"{d} - SQRT(POWER({p1} - {wilson(tp, tn, '-')}, 2) + POWER({wilson(cp, cn, '+')} - {p0}, 2))"
    hi = f"{d} + SQRT(POWER({wilson(tp, tn, '+')} - {p1}, 2) + POWER({p0} - {wilson(cp, cn, '-')}, 2))"
    return (f"{keys}{tn} AS treatment_count, {cn} AS control_count, "
            f"{tp} AS treatment_positive, {cp} AS control_positive, "
            f"{R(p1, 'treatment_rate')}, {R(p0, 'control_rate')}, "
            f"{R(d, 'observed_difference')}, {R(lo, 'observed_difference_ci_lower')}, "
            f"{R(hi, 'observed_difference_ci_upper')}, {R(num(0.95), 'confidence_level')}")


def observed_group_effect_by_segment() -> str:
    return with_overlay(f""",
g AS (
  SELECT f4, COUNT(*) FILTER (WHERE treatment = 1) AS tn,
         COUNT(*) FILTER (WHERE treatment = 0) AS cn,
         COUNT(*) FILTER (WHERE treatment = 1 AND visit = 1) AS tp,
         COUNT(*) FILTER (WHERE treatment = 0 AND visit = 1) AS cp
  FROM exp GROUP BY f4
)
SELECT {_newcombe_select('f4, ', 'tp', 'tn', 'cp', 'cn')} FROM g""")


# ---- balance -------------------------------------------------------------

CONTINUOUS = ("f0", "f2", "f7", "f10")
CATEGORICAL = ("f1", "f3", "f4", "f5", "f6", "f8", "f9", "f11")
INF_SQL = num(float("inf"))


def continuous_balance() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, treatment FROM exp" for f in CONTINUOUS)
    return with_overlay(f""",
long AS ({long}),
g AS (
  SELECT feature, AVG(x) FILTER (WHERE treatment = 1) AS m1,
         AVG(x) FILTER (WHERE treatment = 0) AS m0,
         STDDEV_SAMP(x) FILTER (WHERE treatment = 1) AS s1,
         STDDEV_SAMP(x) FILTER (WHERE treatment = 0) AS s0
  FROM long GROUP BY feature
),
h AS (
  SELECT *, SQRT((s1 * s1 + s0 * s0) / 2) AS pooled FROM g
),
k AS (
  SELECT *, CASE WHEN pooled > 0 THEN (m1 - m0) / pooled WHEN m1 = m0 THEN {num(0.0)}
                 ELSE {INF_SQL} END AS smd FROM h
)
SELECT feature, {R('m1', 'treatment_mean')}, {R('m0', 'control_mean')},
       {R('s1', 'treatment_standard_deviation')}, {R('s0', 'control_standard_deviation')},
       {R('smd', 'standardized_mean_difference')},
       {R('ABS(smd)', 'absolute_standardized_mean_difference')},
       {R('CASE WHEN s0 <> 0 THEN (s1 * s1) / (s0 * s0) END', 'variance_ratio')}
FROM k""")


def _level_cte() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, treatment FROM exp"
        for f in CATEGORICAL)
    return f""",
clong AS ({long}),
lc AS (
  SELECT feature, level, COUNT(*) FILTER (WHERE treatment = 1) AS treatment_count,
         COUNT(*) FILTER (WHERE treatment = 0) AS control_count
  FROM clong GROUP BY feature, level
),
lt AS (
  SELECT *, SUM(treatment_count) OVER (PARTITION BY feature) AS n1,
         SUM(control_count) OVER (PARTITION BY feature) AS n0 FROM lc
),
lp AS (
  SELECT *, treatment_count / n1 AS p1, control_count / n0 AS p0,
         (treatment_count + control_count) / (n1 + n0) AS w FROM lt
),
ls AS (
  SELECT *, SQRT((p1 * (1 - p1) + p0 * (1 - p0)) / 2) AS pooled FROM lp
),
lv AS (
  SELECT *, CASE WHEN pooled > 0 THEN (p1 - p0) / pooled ELSE {num(0.0)} END AS smd FROM ls
)"""


def categorical_level_balance() -> str:
    return with_overlay(f"""{_level_cte()}
SELECT feature, level, treatment_count, control_count,
       {R('p1', 'treatment_proportion')}, {R('p0', 'control_proportion')},
       {R('smd', 'standardized_difference')}, {R('w', 'pooled_weight')}
FROM lv""")


def _categorical_feature_cte() -> str:
    return f"""{_level_cte()},
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY ABS(smd) DESC, level ASC) AS rn
  FROM lv
),
cf AS (
  SELECT feature, COUNT(*) AS level_count, MAX(ABS(smd)) AS mx,
         SQRT(SUM(w * smd * smd)) AS rms,
         MAX(level) FILTER (WHERE rn = 1) AS lvl,
         MAX(p1) FILTER (WHERE rn = 1) AS lp1, MAX(p0) FILTER (WHERE rn = 1) AS lp0,
         MAX(smd) FILTER (WHERE rn = 1) AS lsmd
  FROM ranked GROUP BY feature
)"""


def categorical_balance() -> str:
    return with_overlay(f"""{_categorical_feature_cte()}
SELECT feature, level_count, {R('mx', 'maximum_absolute_standardized_difference')},
       {R('rms', 'weighted_rms_standardized_difference')}, lvl AS maximum_difference_level,
       {R('lp1', 'maximum_level_treatment_proportion')},
       {R('lp0', 'maximum_level_control_proportion')},
       {R('lsmd', 'maximum_level_standardized_difference')}
FROM cf""")


def balance_summary(threshold: float = 0.10) -> str:
    cont = continuous_balance().split("\nSELECT feature, ")[0]
    # reuse the continuous CTE chain (ends at k), then add the categorical chain
    cat = _categorical_feature_cte()
    return f"""{cont}{cat},
mx AS (
  SELECT (SELECT MAX(ABS(smd)) FROM k) AS mc, (SELECT MAX(mx) FROM cf) AS mk
)
SELECT {R('mc', 'maximum_continuous_standardized_difference')},
       {R('mk', 'maximum_categorical_standardized_difference')},
       {R('GREATEST(mc, mk)', 'maximum_absolute_standardized_difference')},
       GREATEST(mc, mk) < {num(threshold)} AS all_features_below_threshold,
       {R(num(threshold), 'threshold')}
FROM mx"""


# ---- validation and profiles ----------------------------------------------

NUMERIC_COLUMNS = (("id", "bigint"), ("f0", "double"), ("f2", "double"), ("f7", "double"),
                   ("f10", "double"), ("treatment", "int"), ("exposure", "int"),
                   ("visit", "int"), ("conversion", "int"))
BINARIES = ("treatment", "exposure", "visit", "conversion")


def _profile_select(table: str, col: str, dtype: str, dtype_label: str | None = None) -> str:
    floating = dtype == "double"
    fin = (f"CASE WHEN NOT ISNAN({col}) AND ABS({col}) <> {INF_SQL} THEN {col} END"
           if floating else f"CAST({col} AS DOUBLE)")
    nf = (f"COUNT(*) FILTER (WHERE ISNAN({col}) OR ABS({col}) = {INF_SQL})" if floating
          else "CAST(0 AS BIGINT)")
    return (f"SELECT '{col}' AS column_name, '{dtype_label or dtype}' AS dtype, "
            f"COUNT(*) FILTER (WHERE {col} IS NULL) AS missing_count, {nf} AS nonfinite_count, "
            f"MIN({fin}) AS minimum, MAX({fin}) AS maximum, AVG({fin}) AS mean, "
            f"STDDEV_POP({fin}) AS standard_deviation FROM {table}")


def column_profile() -> str:
    body = " UNION ALL ".join(_profile_select("exp", c, t) for c, t in NUMERIC_COLUMNS)
    return with_overlay(f""",
p AS ({body})
SELECT column_name, dtype, missing_count, nonfinite_count, {R('minimum', 'minimum')},
       {R('maximum', 'maximum')}, {R('mean', 'mean')},
       {R('standard_deviation', 'standard_deviation')}
FROM p""")


def binary_profile() -> str:
    parts = []
    for b in BINARIES:
        c = f"CAST({b} AS DOUBLE)"
        bad = f"{c} IS NOT NULL AND {c} NOT IN (0, 1)"
        parts.append(
            f"SELECT '{b}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
            f"COUNT(*) FILTER (WHERE {c} = 0) AS count_0, COUNT(*) FILTER (WHERE {c} = 1) AS count_1, "
            f"COUNT(*) FILTER (WHERE {bad}) AS invalid_count, "
            f"MIN(CASE WHEN {bad} THEN {c} END) AS invalid_minimum, "
            f"MAX(CASE WHEN {bad} THEN {c} END) AS invalid_maximum FROM exp")
    body = " UNION ALL ".join(parts)
    return with_overlay(f""",
p AS ({body})
SELECT column_name, missing_count, count_0, count_1, invalid_count,
       {R('invalid_minimum', 'invalid_minimum')}, {R('invalid_maximum', 'invalid_maximum')},
       {R('CASE WHEN count_0 + count_1 > 0 THEN count_0 / (count_0 + count_1) END', 'proportion_0')},
       {R('CASE WHEN count_0 + count_1 > 0 THEN count_1 / (count_0 + count_1) END', 'proportion_1')},
       invalid_count = 0 AS valid
FROM p""")


def logical_violations() -> str:
    return with_overlay("""
SELECT 'conversion_without_visit' AS rule,
       COUNT(*) FILTER (WHERE conversion = 1 AND visit <> 1) AS violation_count FROM exp
UNION ALL
SELECT 'exposure_without_treatment',
       COUNT(*) FILTER (WHERE exposure = 1 AND treatment <> 1) FROM exp""")


def duplicate_rows() -> str:
    return with_overlay("""
SELECT COUNT(*) AS row_count, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM exp)) AS distinct_rows,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM exp)) AS duplicate_full_rows
FROM exp""")


def duplicate_rows_features() -> str:
    return with_overlay(f""",
d AS (SELECT DISTINCT * EXCLUDE (id) FROM exp)
SELECT (SELECT COUNT(*) FROM exp) AS row_count, COUNT(*) AS distinct_rows,
       (SELECT COUNT(*) FROM exp) - COUNT(*) AS duplicate_full_rows FROM d""")


def feature_cardinality() -> str:
    body = " UNION ALL ".join(
        f"SELECT 'f{i}' AS feature, COUNT(DISTINCT f{i}) AS cardinality FROM exp" for i in range(12))
    return with_overlay(f"\n{body}")


def table_equivalence() -> str:
    right_cols = ", ".join(
        [f"f{i}" for i in range(12)] + ["id"]
        + [f"CAST({b} AS TINYINT) AS {b}" for b in BINARIES])
    lp = " UNION ALL ".join(_profile_select("exp", c, t) for c, t in NUMERIC_COLUMNS)
    rp = " UNION ALL ".join(
        _profile_select("exp2", c, t, "tinyint" if c in BINARIES else t) for c, t in NUMERIC_COLUMNS)

    def close(s: str) -> str:
        a, b = f"l.{s}", f"r.{s}"
        return (f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN TRUE WHEN {a} IS NULL OR {b} IS NULL "
                f"THEN FALSE ELSE ABS({a} - {b}) <= GREATEST({num(1e-10)} * GREATEST(ABS({a}), "
                f"ABS({b})), {num(1e-12)}) END")

    stats = " AND ".join(close(s) for s in ("minimum", "maximum", "mean", "standard_deviation"))
    feats = ", ".join(f"'f{i}'" for i in range(12))
    bins = " UNION ALL ".join(
        f"SELECT '{b}' AS c, COUNT(*) FILTER (WHERE {b} = 0) AS z, COUNT(*) FILTER (WHERE {b} = 1) AS o "
        f"FROM {{t}}" for b in BINARIES)
    return with_overlay(f""",
exp2 AS (SELECT {right_cols} FROM exp),
lp AS ({lp}), rp AS ({rp}),
cmp AS (
  SELECT COALESCE(l.column_name, r.column_name) AS column_name,
         COALESCE(l.missing_count = r.missing_count, FALSE) AS missing_match,
         {stats} AS statistics_match
  FROM lp l FULL OUTER JOIN rp r ON l.column_name = r.column_name
),
lb AS ({bins.format(t='exp')}), rb AS ({bins.format(t='exp2')})
SELECT 'row_count' AS check_name, (SELECT COUNT(*) FROM exp) = (SELECT COUNT(*) FROM exp2) AS passed
UNION ALL SELECT 'column_names', TRUE
UNION ALL SELECT 'missing_counts', COALESCE(BOOL_AND(missing_match), TRUE) FROM cmp
UNION ALL SELECT 'binary_counts', COALESCE(BOOL_AND(COALESCE(lb.z = rb.z AND lb.o = rb.o, FALSE)), TRUE)
          FROM lb FULL OUTER JOIN rb ON lb.c = rb.c
UNION ALL SELECT 'feature_statistics', COALESCE(BOOL_AND(statistics_match), TRUE)
          FROM cmp WHERE column_name IN ({feats})""")


# ---- ranking -----------------------------------------------------------------

from liftlab.sources.overlay import RULE_P0_SQL, RULE_SCORES_SQL  # noqa: E402


def _ranked_cte(outcome: str) -> str:
    return f""",
sc AS (SELECT id, {outcome} AS y, treatment AS t, {RULE_SCORES_SQL} AS score FROM exp),
rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, id ASC) AS rnk FROM sc),
tot AS (
  SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE t = 1) AS tn, COUNT(*) FILTER (WHERE t = 0) AS cn,
         COUNT(*) FILTER (WHERE t = 1 AND y = 1) AS tp, COUNT(*) FILTER (WHERE t = 0 AND y = 1) AS cp
  FROM rk
)"""


def _z(tp: str, cp: str, p: float = 0.85) -> str:
    return f"({tp} / {num(p)} - {cp} / {num(1 - p)})"


def _gain_cte(outcome: str, points: int = 100) -> str:
    return f"""{_ranked_cte(outcome)},
pts AS (
  SELECT CAST(range AS INTEGER) AS point,
         CASE WHEN range = {points} THEN {num(1.0)} ELSE range * {num(1.0 / points)} END AS fraction
  FROM range(0, {points + 1})
),
ptk AS (
  SELECT point, fraction,
         CASE WHEN point = 0 THEN 0 WHEN point = {points} THEN n
              ELSE CAST(CEIL(fraction * n) AS BIGINT) END AS k,
         n, tp AS all_tp, cp AS all_cp
  FROM pts, tot
),
gc AS (
  SELECT point, fraction, k, n, all_tp, all_cp,
         COUNT(rk.id) FILTER (WHERE rk.t = 1 AND rk.y = 1) AS ctp,
         COUNT(rk.id) FILTER (WHERE rk.t = 0 AND rk.y = 1) AS ccp
  FROM ptk LEFT JOIN rk ON rk.rnk <= ptk.k
  GROUP BY point, fraction, k, n, all_tp, all_cp
),
g2 AS (
  SELECT *, {_z('ctp', 'ccp')} / n * {num(1e5)} AS policy,
         {_z('all_tp', 'all_cp')} / n * {num(1e5)} AS treat_all FROM gc
)"""


def gain_curve() -> str:
    return with_overlay(f"""{_gain_cte('visit')}
SELECT point, {R('fraction', 'fraction')}, k AS targeted_count,
       {R('policy', 'policy_gain_per_100000')},
       {R('fraction * treat_all', 'random_gain_per_100000')},
       {R('treat_all', 'treat_all_gain_per_100000')}
FROM g2""")


def auuc() -> str:
    return with_overlay(f"""{_gain_cte('visit')},
g3 AS (
  SELECT *, policy - fraction * treat_all AS d,
         LAG(policy - fraction * treat_all) OVER (ORDER BY point) AS d0,
         LAG(fraction) OVER (ORDER BY point) AS f0
  FROM g2
)
SELECT {R('SUM(CASE WHEN d0 IS NOT NULL THEN (d0 + d) / 2 * (fraction - f0) END)',
          'auuc_above_random_per_100000')},
       {R('MAX(treat_all)', 'treat_all_gain_per_100000')},
       MAX(n) AS observations
FROM g3""")


def targeting_policy(fractions=(0.05, 0.10, 0.20, 0.30, 0.50, 1.00)) -> str:
    vals = ", ".join(f"({num(f)})" for f in fractions)
    return with_overlay(f"""{_ranked_cte('conversion')},
fr AS (SELECT col0 AS fraction FROM (VALUES {vals})),
fk AS (
  SELECT fraction, LEAST(n, GREATEST(1, CAST(CEIL(fraction * n) AS BIGINT))) AS k,
         n, tn AS all_tn, cn AS all_cn, tp AS all_tp, cp AS all_cp
  FROM fr, tot
),
pc AS (
  SELECT fraction, k, n, all_tn, all_cn, all_tp, all_cp,
         COUNT(*) FILTER (WHERE rk.t = 1) AS tn, COUNT(*) FILTER (WHERE rk.t = 0) AS cn,
         COUNT(*) FILTER (WHERE rk.t = 1 AND rk.y = 1) AS tp,
         COUNT(*) FILTER (WHERE rk.t = 0 AND rk.y = 1) AS cp
  FROM fk JOIN rk ON rk.rnk <= fk.k
  GROUP BY fraction, k, n, all_tn, all_cn, all_tp, all_cp
),
pd AS (
  SELECT *, (tp / tn - cp / cn) AS diff, (all_tp / all_tn - all_cp / all_cn) AS all_diff FROM pc
)
SELECT {R('fraction', 'fraction')}, k AS targeted_count,
       {R('diff', 'estimated_incremental_outcome_rate_among_targeted')},
       {R('diff * (k / n) * 100000', 'incremental_outcomes_per_100000_population')},
       {R('all_diff * (k / n) * 100000', 'random_targeting_per_100000_population')},
       {R('diff * (k / n) * 100000 - all_diff * (k / n) * 100000',
          'incremental_outcomes_above_random_per_100000')},
       {R(f"{_z('tp', 'cp')} / k", 'ipw_transformed_outcome_rate_among_targeted')},
       {_newcombe_select('', 'tp', 'tn', 'cp', 'cn')},
       cp < 20 AS insufficient_control_events, 20 AS control_event_threshold
FROM pd""")


def uplift_deciles() -> str:
    return with_overlay(f"""{_ranked_cte('visit')},
dt AS (SELECT *, NTILE(10) OVER (ORDER BY score DESC, id ASC) AS dec FROM rk),
dg AS (
  SELECT dec, COUNT(*) AS n, AVG(score) AS ms,
         COUNT(*) FILTER (WHERE t = 1) AS tn, COUNT(*) FILTER (WHERE t = 0) AS cn,
         COUNT(*) FILTER (WHERE t = 1 AND y = 1) AS tp, COUNT(*) FILTER (WHERE t = 0 AND y = 1) AS cp
  FROM dt GROUP BY dec
)
SELECT CAST(dec AS INTEGER) AS rank, n AS observations, {R('ms', 'mean_predicted_uplift')},
       {_newcombe_select('', 'tp', 'tn', 'cp', 'cn')},
       FALSE AS insufficient_control_events, 20 AS control_event_threshold
FROM dg""")


def cate_summary() -> str:
    qs = [("0.05", "percentile_05"), ("0.25", "percentile_25"), ("0.5", "median"),
          ("0.75", "percentile_75"), ("0.95", "percentile_95")]
    qsel = ", ".join(R(f"QUANTILE_CONT(score, {q})", name) for q, name in qs)
    return with_overlay(f"""{_ranked_cte('visit')}
SELECT {R('AVG(score)', 'mean')}, {R('STDDEV_POP(score)', 'standard_deviation')},
       {R('MIN(score)', 'minimum')}, {qsel}, {R('MAX(score)', 'maximum')},
       {R('AVG(CASE WHEN score > 0 THEN 1.0E0 ELSE 0.0E0 END)', 'proportion_positive')},
       {R('AVG(CASE WHEN score < 0 THEN 1.0E0 ELSE 0.0E0 END)', 'proportion_negative')},
       {R('(SELECT tp / tn - cp / cn FROM tot)', 'held_out_test_ate')},
       {R('AVG(score) - (SELECT tp / tn - cp / cn FROM tot)', 'mean_minus_held_out_test_ate')}
FROM rk""")


def predictive_diagnostics() -> str:
    return with_overlay(f""",
sc AS (
  SELECT id, visit AS y, treatment AS t, {RULE_P0_SQL} AS p0,
         {RULE_P0_SQL} + {RULE_SCORES_SQL} AS p1 FROM exp
),
st AS (
  SELECT 'overall' AS grp, id, y, CASE WHEN t = 1 THEN p1 ELSE p0 END AS p FROM sc
  UNION ALL SELECT 'treated_p1', id, y, p1 FROM sc WHERE t = 1
  UNION ALL SELECT 'control_p0', id, y, p0 FROM sc WHERE t = 0
),
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY p, id) AS r FROM st),
ties AS (
  SELECT grp, p, MIN(r) AS r0, MAX(r) AS r1, COUNT(*) FILTER (WHERE y = 1) AS pos FROM rr
  GROUP BY grp, p
),
auc AS (
  SELECT grp, SUM(pos) AS n1, SUM(pos * (r0 + r1)) / 2.0E0 AS rs FROM ties GROUP BY grp
),
ll AS (
  SELECT grp, COUNT(*) AS observations, COUNT(*) FILTER (WHERE y = 1) AS positive,
         AVG(-(y * LN(p) + (1 - y) * LN(1 - p))) AS log_loss
  FROM st GROUP BY grp
)
SELECT ll.grp AS "group", observations, positive, {R('log_loss', 'log_loss')},
       {R('CASE WHEN n1 > 0 AND observations - n1 > 0 THEN (rs - n1 * (n1 + 1) / 2.0E0) / (n1 * (observations - n1)) END', 'roc_auc')}
FROM ll JOIN auc ON ll.grp = auc.grp""")


# ---- sampling, splitting, power -----------------------------------------------

from liftlab.functions.normal import detectable_shift  # noqa: E402
from liftlab.operators.sampling import sample_key_sql  # noqa: E402


def sample_rows(n: int = 5000, seed: int = 42) -> str:
    return with_overlay(f""",
k AS (SELECT id, treatment, visit, conversion, {sample_key_sql('id', seed)} AS key FROM exp),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY key, id) AS rn FROM k)
SELECT id, treatment, visit, conversion FROM r WHERE rn <= {n}""")


def _split_cte(seed: int = 42) -> str:
    return f""",
s0 AS (
  SELECT id, treatment, visit, conversion,
         CAST(4 * treatment + 2 * visit + conversion AS INTEGER) AS stratum,
         {sample_key_sql('id', seed)} AS key
  FROM exp
),
sc AS (SELECT stratum, COUNT(*) AS ns FROM s0 GROUP BY stratum),
tot AS (SELECT SUM(ns) AS n, CAST(CEIL({num(0.4)} * SUM(ns)) AS BIGINT) AS nhold FROM sc),
t1 AS (
  SELECT stratum, ns, n - nhold AS ntrain, (ns * (n - nhold)) // n AS base,
         (ns * (n - nhold)) % n AS rem
  FROM sc, tot
),
t2 AS (
  SELECT *, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, stratum)
                            <= ntrain - SUM(base) OVER () THEN 1 ELSE 0 END AS train
  FROM t1
),
h1 AS (SELECT stratum, ns, train, ns - train AS hold, SUM(ns - train) OVER () AS nh FROM t2),
h2 AS (SELECT *, CAST(CEIL({num(0.5)} * nh) AS BIGINT) AS ntest FROM h1),
h3 AS (SELECT *, (hold * ntest) // nh AS tb, (hold * ntest) % nh AS trem FROM h2),
h4 AS (
  SELECT *, tb + CASE WHEN ROW_NUMBER() OVER (ORDER BY trem DESC, stratum)
                          <= ntest - SUM(tb) OVER () THEN 1 ELSE 0 END AS test
  FROM h3
),
rk AS (SELECT s0.*, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY key, id) AS pos FROM s0),
sp AS (
  SELECT rk.id, rk.stratum, rk.treatment, rk.visit, rk.conversion,
         CASE WHEN pos <= train THEN 'train' WHEN pos <= train + hold - test THEN 'validation'
              ELSE 'test' END AS split
  FROM rk JOIN h4 ON rk.stratum = h4.stratum
)"""


def split_assignment() -> str:
    return with_overlay(f"""{_split_cte()}
SELECT id, stratum, split FROM sp""")


def split_summary() -> str:
    sel = []
    for o in ("visit", "conversion"):
        sel += [f"COUNT(*) FILTER (WHERE {o} = 1) AS {o}_positive",
                R(f"AVG(CAST({o} AS DOUBLE))", f"{o}_rate"),
                f"COUNT(*) FILTER (WHERE {o} = 1 AND treatment = 1) AS {o}_treatment_positive",
                R(f"AVG(CAST({o} AS DOUBLE)) FILTER (WHERE treatment = 1)", f"{o}_treatment_rate"),
                f"COUNT(*) FILTER (WHERE {o} = 1 AND treatment = 0) AS {o}_control_positive",
                R(f"AVG(CAST({o} AS DOUBLE)) FILTER (WHERE treatment = 0)", f"{o}_control_rate")]
    return with_overlay(f"""{_split_cte()}
SELECT split, COUNT(*) AS observations, COUNT(*) FILTER (WHERE treatment = 1) AS treatment_count,
       COUNT(*) FILTER (WHERE treatment = 0) AS control_count,
       {R('AVG(CAST(treatment AS DOUBLE))', 'treatment_rate')}, {', '.join(sel)}
FROM sp GROUP BY split""")


def stratum_counts() -> str:
    return with_overlay("""
SELECT CAST(4 * treatment + 2 * visit + conversion AS INTEGER) AS stratum, COUNT(*) AS rows
FROM exp GROUP BY 1""")


def mde_grid(powers=(0.8, 0.9), alpha: float = 0.05) -> str:
    vals = ", ".join(f"({num(p)}, {num(alpha)}, {num(detectable_shift(p, alpha))})"
                     for p in powers)
    b, n1, n0 = "b", "treatment_count", "control_count"
    h = f"(d * SQRT({num(1.0)} / {n1} + {num(1.0)} / {n0}))"
    absolute = (f"CASE WHEN b > 0 AND b < 1 THEN POWER(SIN(({num(2.0)} * ASIN(SQRT(b)) + ABS({h}))"
                f" / {num(2.0)}), 2) - b END")
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()},
g AS (SELECT col0 AS power, col1 AS alpha, col2 AS d FROM (VALUES {vals})),
m AS (SELECT outcome, treatment_count, control_count,
             control_positive / control_count AS b FROM counts)
SELECT outcome, {R('power', 'power')}, {R('alpha', 'alpha')}, {R('b', 'baseline_control_rate')},
       treatment_count, control_count, {R(absolute, 'absolute_effect')},
       {R(f'({absolute}) / b', 'relative_effect')},
       {R(f'({absolute}) / b * 100', 'relative_effect_percent')}
FROM m, g""")


def sample_size_grid(targets=(0.001, 0.002, 0.005, 0.01), shares=(0.5, 0.85),
                     powers=(0.8, 0.9), alpha: float = 0.05) -> str:
    vals = ", ".join(f"({num(e)}, {num(s)}, {num(p)}, {num(alpha)}, "
                     f"{num(detectable_shift(p, alpha))})"
                     for e in targets for s in shares for p in powers)
    h = f"ABS({num(2.0)} * ASIN(SQRT(b + e)) - {num(2.0)} * ASIN(SQRT(b)))"
    ratio = f"(s / ({num(1.0)} - s))"
    control = f"(POWER(d / {h}, 2) * ({num(1.0)} + {ratio}) / {ratio})"
    total = (f"CASE WHEN b > 0 AND b < 1 AND b + e > 0 AND b + e < 1 AND {h} > 0 "
             f"THEN CAST(CEIL({control} * ({num(1.0)} + {ratio})) AS BIGINT) END")
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()},
g AS (SELECT col0 AS e, col1 AS s, col2 AS power, col3 AS alpha, col4 AS d
      FROM (VALUES {vals})),
m AS (SELECT outcome, control_positive / control_count AS b FROM counts)
SELECT outcome, {R('e', 'target_absolute_effect')}, {R('s', 'treatment_share')},
       {R('power', 'power')}, {R('alpha', 'alpha')}, {R('b', 'baseline_control_rate')},
       {total} AS required_total_sample_size
FROM m, g""")


# ---- chart-ready tables ---------------------------------------------------------

def chart_effects() -> str:
    zc = num(Z975)
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()},
r AS (SELECT outcome, treatment_positive / treatment_count AS tr,
             control_positive / control_count AS cr, treatment_count AS tn, control_count AS cn
      FROM counts),
s AS (SELECT *, tr - cr AS rd, SQRT(tr * (1 - tr) / tn + cr * (1 - cr) / cn) AS se FROM r)
SELECT outcome, {R('rd * 100', 'effect_pp')},
       {R(f'GREATEST({num(-1.0)}, rd - {zc} * se) * 100', 'ci_lower_pp')},
       {R(f'LEAST({num(1.0)}, rd + {zc} * se) * 100', 'ci_upper_pp')}
FROM s""")


def chart_balance(threshold: float = 0.10) -> str:
    cont = continuous_balance().split("\nSELECT feature, ")[0]
    return f"""{cont}{_categorical_feature_cte()}
SELECT feature, 'continuous' AS kind, {R('ABS(smd)', 'value')}, {R(num(threshold), 'threshold')}
FROM k
UNION ALL
SELECT feature, 'categorical', {R('mx', 'value')}, {R(num(threshold), 'threshold')} FROM cf"""


def chart_sensitivity(powers=(0.8, 0.9), alpha: float = 0.05) -> str:
    zc = num(Z975)
    vals = ", ".join(f"({num(p)}, {num(detectable_shift(p, alpha))})" for p in powers)
    h = f"(d * SQRT({num(1.0)} / tn + {num(1.0)} / cn))"
    absolute = (f"CASE WHEN b > 0 AND b < 1 THEN POWER(SIN(({num(2.0)} * ASIN(SQRT(b)) + ABS({h}))"
                f" / {num(2.0)}), 2) - b END")
    return with_overlay(f""", {_pop_cte()}, {_counts_cte()},
g AS (SELECT col0 AS power, col1 AS d FROM (VALUES {vals})),
r AS (SELECT outcome, treatment_positive / treatment_count AS tr,
             control_positive / control_count AS cr, control_positive / control_count AS b,
             treatment_count AS tn, control_count AS cn
      FROM counts),
s AS (SELECT *, tr - cr AS rd, SQRT(tr * (1 - tr) / tn + cr * (1 - cr) / cn) AS se FROM r),
m AS (SELECT outcome, MAX(CASE WHEN power = {num(powers[0])} THEN {absolute} END) AS m80,
             MAX(CASE WHEN power = {num(powers[1])} THEN {absolute} END) AS m90
      FROM r, g GROUP BY outcome)
SELECT s.outcome, {R('rd * 100', 'effect_pp')},
       {R(f'GREATEST({num(-1.0)}, rd - {zc} * se) * 100', 'ci_lower_pp')},
       {R(f'LEAST({num(1.0)}, rd + {zc} * se) * 100', 'ci_upper_pp')},
       {R('m80 * 100', 'mde_80_pp')}, {R('m90 * 100', 'mde_90_pp')}
FROM s JOIN m ON s.outcome = m.outcome""")


def chart_gain() -> str:
    return f"""SELECT 'visit' AS outcome, 'rule' AS learner, fraction, policy_gain_per_100000,
       random_gain_per_100000, treat_all_gain_per_100000
FROM ({gain_curve()}) AS q"""


def chart_policy() -> str:
    return f"""SELECT 'conversion' AS outcome, 'rule' AS learner, fraction,
       incremental_outcomes_per_100000_population, random_targeting_per_100000_population,
       observed_difference_ci_lower, observed_difference_ci_upper, insufficient_control_events
FROM ({targeting_policy()}) AS q"""


def t_learner_cell_counts() -> str:
    """Positives per (f4 cell, arm) of the training split: what a saturated
    T-learner's probabilities times the cell sizes must give back."""
    return with_overlay(f"""{_split_cte()}
SELECT exp.f4, COUNT(*) FILTER (WHERE sp.treatment = 1) AS treated_rows,
       COUNT(*) FILTER (WHERE sp.treatment = 0) AS control_rows,
       COUNT(*) FILTER (WHERE sp.treatment = 1 AND sp.visit = 1) AS recovered_treated_positives,
       COUNT(*) FILTER (WHERE sp.treatment = 0 AND sp.visit = 1) AS recovered_control_positives
FROM sp JOIN exp ON sp.id = exp.id
WHERE sp.split = 'train'
GROUP BY exp.f4""")


def design_matrix(continuous=("f0", "f2", "f7", "f10"),
                  categorical=("f1", "f3", "f4", "f5", "f6", "f8", "f9", "f11")) -> str:
    """Training design matrix: one slot per continuous feature and per
    training level (unseen levels encode as zeros, so every training row has
    one non-zero per categorical); a scaled continuous value is zero only at
    the training mean."""
    levels = " + ".join(f"COUNT(DISTINCT {c})" for c in categorical)
    nonzero = " + ".join(f"COUNT(*) FILTER (WHERE {c} <> m_{c})" for c in continuous)
    means = ", ".join(f"AVG({c}) AS m_{c}" for c in continuous)
    return with_overlay(f"""{_split_cte()},
tr AS (SELECT exp.* FROM sp JOIN exp ON sp.id = exp.id WHERE sp.split = 'train'),
mu AS (SELECT {means} FROM tr),
lv AS (SELECT {levels} AS n_levels FROM tr)
SELECT CAST(COUNT(*) AS BIGINT) AS rows,
       CAST({len(continuous)} + MAX(n_levels) AS INTEGER) AS columns,
       CAST({len(categorical)} * COUNT(*) + {nonzero} AS BIGINT) AS nonzero_values
FROM tr, mu, lv""")


def s_learner_cell_counts() -> str:
    """A saturated S-learner gives the same cell rates back."""
    return t_learner_cell_counts()


def invalid_assignment() -> str:
    names = ("treatment", "visit", "conversion")
    cols = ", ".join([f"COUNT(*) FILTER (WHERE {n} IS NULL) AS {n}_missing" for n in names]
                     + [f"COUNT(*) FILTER (WHERE {n} NOT IN (0, 1)) AS {n}_invalid" for n in names])
    return with_overlay(f"""
SELECT f4, COUNT(*) AS rows, {cols} FROM exp GROUP BY f4""")


def approx_cardinality_within_bounds() -> str:
    return with_overlay("\n" + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, TRUE AS within_three_rsd"
                                                  for i in range(12)))


def table_summary() -> str:
    parts = ["SELECT 'table' AS section, 'row_count' AS name, COUNT(*) AS value FROM exp",
             "SELECT 'table', 'column_count', 17"]
    parts += [f"SELECT 'missing', '{c}', COUNT(*) FILTER (WHERE {c} IS NULL) FROM exp"
              for c, _ in NUMERIC_COLUMNS]
    parts += [f"SELECT 'ones', '{b}', COUNT(*) FILTER (WHERE {b} = 1) FROM exp" for b in BINARIES]
    return with_overlay("\n" + " UNION ALL ".join(parts) + f"""
UNION ALL SELECT 'violation', rule, violation_count FROM (
SELECT 'conversion_without_visit' AS rule,
       COUNT(*) FILTER (WHERE conversion = 1 AND visit <> 1) AS violation_count FROM exp
UNION ALL SELECT 'exposure_without_treatment',
       COUNT(*) FILTER (WHERE exposure = 1 AND treatment <> 1) FROM exp)""")


def allocation_p_value(p: float = 0.85, steps: int = 4000) -> str:
    """Tail of the normal by Simpson's rule over the density: another route than the library's."""
    return with_overlay(f""",
z AS (SELECT ABS(SUM(treatment) - COUNT(*) * {num(p)}) / SQRT(COUNT(*) * {num(p * (1 - p))}) AS z FROM exp),
g AS (SELECT z, i, CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * EXP(-POW(z * i / {steps}, 2) / 2) / SQRT(2 * PI()) AS f
      FROM z, (SELECT UNNEST(RANGE({steps} + 1)) AS i))
SELECT ROUND(1 - 2 * MAX(z) / {steps} / 3 * SUM(f), 9) AS p_value FROM g""")


def treatment_predictability_baseline(share: float = 0.25, seed: int = 42) -> str:
    """Split sizes and the base-rate log loss of the held-out rows."""
    return with_overlay(f""",
s0 AS (SELECT id, treatment, {sample_key_sql('id', seed)} AS key FROM exp),
sc AS (SELECT treatment, COUNT(*) AS ns FROM s0 GROUP BY treatment),
tot AS (SELECT SUM(ns) AS n, CAST(CEIL({num(share)} * SUM(ns)) AS BIGINT) AS nhold FROM sc),
t1 AS (SELECT treatment, n - nhold AS ntrain, (ns * (n - nhold)) // n AS base, (ns * (n - nhold)) % n AS rem
       FROM sc, tot),
t2 AS (SELECT treatment, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, treatment)
                             <= ntrain - SUM(base) OVER () THEN 1 ELSE 0 END AS train FROM t1),
rk AS (SELECT s0.*, ROW_NUMBER() OVER (PARTITION BY treatment ORDER BY key, id) AS pos FROM s0),
sp AS (SELECT rk.treatment AS t, pos <= train AS is_train FROM rk JOIN t2 ON rk.treatment = t2.treatment),
b AS (SELECT AVG(CAST(t AS DOUBLE)) AS base FROM sp WHERE is_train)
SELECT COUNT(*) FILTER (WHERE is_train) AS training_observations,
       COUNT(*) FILTER (WHERE NOT is_train) AS test_observations,
       {R("AVG(CASE WHEN NOT is_train THEN -(t * LN(base) + (1 - t) * LN(1 - base)) END)", "baseline_log_loss")}
FROM sp, b""")


def code_sql(column: str) -> str:
    """Numeric code of a string level."""
    return f"CAST('0x' || substr(md5({column}), 1, 4) AS BIGINT)"


def prepare_dataset() -> str:
    """Profile of the published Parquet copy: integers stay integers."""
    kinds = {"f0": "double", "f2": "double", "f7": "double", "f10": "double"}
    cols = [f"f{i}" for i in range(12)]
    texts = ("f1", "f3", "f4")
    select = ", ".join([f"{code_sql(c)} AS {c}" if c in texts else c if c in kinds
                        else f"CAST({c} AS BIGINT) AS {c}" for c in cols] + list(BINARIES))
    body = " UNION ALL ".join(
        [_profile_select("t", c, kinds.get(c, "bigint")) for c in cols]
        + [_profile_select("t", c, "tinyint") for c in BINARIES])
    return with_overlay(f""",
t AS (SELECT {select} FROM exp),
p AS ({body})
SELECT column_name, dtype, missing_count, nonfinite_count, {R('minimum', 'minimum')},
       {R('maximum', 'maximum')}, {R('mean', 'mean')},
       {R('standard_deviation', 'standard_deviation')}
FROM p""")


def experiment_report() -> str:
    """Rows of every report table that the experiment's shape fixes, and of the level table."""
    fixed = {"population": 1, "analysis_population": 1, "allocation": 1, "continuous_balance": 4,
             "categorical_balance": 8, "balance_summary": 1, "outcome_descriptives": 2, "itt_effects": 2,
             "mde": 4, "exposure_diagnostics": 1, "methods": 6, "limitations": 4, "chart_balance": 12,
             "chart_effects": 2, "chart_sensitivity": 2, "treatment_predictability": 1}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS table_name, CAST({n} AS BIGINT) AS rows" for k, n in fixed.items())
    levels = " + ".join(f"COUNT(DISTINCT {c})" for c in CATEGORICAL)
    return with_overlay(f"""
{rows} UNION ALL SELECT 'categorical_levels', CAST({levels} AS BIGINT) FROM exp""")


# ---- mergeable profiles, sketches, candidates, footers ---------------------------------------------

def segment_profile() -> str:
    body = " UNION ALL ".join(_profile_select("exp", c, t).replace("SELECT ", "SELECT f4, ", 1) + " GROUP BY f4"
                              for c, t in NUMERIC_COLUMNS)
    return with_overlay(f""",
p AS ({body})
SELECT f4, column_name, dtype, missing_count, nonfinite_count, {R('minimum', 'minimum')},
       {R('maximum', 'maximum')}, {R('mean', 'mean')},
       {R('standard_deviation', 'standard_deviation')}
FROM p""")


def merged_cardinality() -> str:
    per = " UNION ALL ".join(
        f"SELECT {seg} AS segment, 'f{i}' AS feature, COUNT(DISTINCT f{i}) AS cardinality FROM exp {group}"
        for i in range(12) for seg, group in (("f6", "GROUP BY f6"), ("'all'", "")))
    return with_overlay(f"SELECT *, TRUE AS within_three_deviations FROM ({per})")


def sketched_quantiles(probabilities=(0.05, 0.25, 0.50, 0.75, 0.95)) -> str:
    return with_overlay(" UNION ALL ".join(
        f"SELECT {num(q)} AS probability, COUNT(*) AS observations, TRUE AS within FROM exp" for q in probabilities))


def _areas_cte(points: int = 100) -> str:
    """From scores (candidate, id, y, t, score): areas (candidate, area, treat_all, n)."""
    return f"""
ar_rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY candidate ORDER BY score DESC, id ASC) AS rnk FROM scores),
ar_tot AS (SELECT candidate, COUNT(*) AS n, COUNT(*) FILTER (WHERE t = 1 AND y = 1) AS tp,
               COUNT(*) FILTER (WHERE t = 0 AND y = 1) AS cp FROM ar_rk GROUP BY candidate),
ar_pts AS (
  SELECT candidate, n, tp, cp, range AS point,
         CASE WHEN range = {points} THEN {num(1.0)} ELSE range * {num(1.0 / points)} END AS fraction,
         CASE WHEN range = {points} THEN n
              ELSE CAST(CEIL(range * {num(1.0 / points)} * n) AS BIGINT) END AS k
  FROM ar_tot, range(0, {points + 1})
),
ar_gc AS (
  SELECT ar_pts.candidate, point, fraction, n, tp, cp,
         COUNT(ar_rk.id) FILTER (WHERE t = 1 AND y = 1) AS ctp, COUNT(ar_rk.id) FILTER (WHERE t = 0 AND y = 1) AS ccp
  FROM ar_pts LEFT JOIN ar_rk ON ar_rk.candidate = ar_pts.candidate AND ar_rk.rnk <= ar_pts.k
  GROUP BY ar_pts.candidate, point, fraction, n, tp, cp
),
ar_g2 AS (
  SELECT *, {_z('tp', 'cp')} / n * {num(1e5)} AS treat_all,
         {_z('ctp', 'ccp')} / n * {num(1e5)} - fraction * ({_z('tp', 'cp')} / n * {num(1e5)}) AS d FROM ar_gc
),
ar_g3 AS (
  SELECT *, LAG(d) OVER w AS d0, LAG(fraction) OVER w AS f0
  FROM ar_g2 WINDOW w AS (PARTITION BY candidate ORDER BY point)
),
areas AS (
  SELECT candidate, SUM(CASE WHEN d0 IS NOT NULL THEN (d0 + d) / 2 * (fraction - f0) END) AS area,
         MAX(treat_all) AS treat_all, MAX(n) AS n
  FROM ar_g3 GROUP BY candidate
)"""


def candidate_selection() -> str:
    return with_overlay(f""",
s0 AS (SELECT id, visit AS y, treatment AS t, {RULE_SCORES_SQL} AS score FROM exp),
scores AS (
  SELECT 'rule' AS candidate, id, y, t, score FROM s0
  UNION ALL SELECT 'reverse', id, y, t, -score FROM s0
  UNION ALL SELECT 'hashed', id, y, t, (id * 7919 % 1000) / {num(1000.0)} FROM s0
),{_areas_cte()}
SELECT candidate, {R('area', 'auuc_above_random_per_100000')},
       {R('treat_all', 'treat_all_gain_per_100000')}, n AS observations
FROM areas""")


def uplift_search(alphas=(1e-5, 1e-4)) -> str:
    """The uplift report with a classifier whose effect rises (first alpha) or falls with the level of f4."""
    parts = " UNION ALL ".join(
        f"SELECT '{o}' AS outcome, {num(a)} AS alpha, split, '{o} {i} ' || split AS candidate, id, {o} AS y, treatment AS t, "
        f"{'' if i == 0 else '-'}level AS score FROM lv WHERE split <> 'train'"
        for o in ("visit", "conversion") for i, a in enumerate(alphas))
    return with_overlay(f"""{_split_cte()},
lv AS (
  SELECT sp.*, f.level FROM sp JOIN exp ON exp.id = sp.id JOIN (
    SELECT f4, CAST(ROW_NUMBER() OVER (ORDER BY f4) AS BIGINT) AS level
    FROM (SELECT DISTINCT f4 FROM sp JOIN exp ON exp.id = sp.id WHERE split = 'train')) f ON f.f4 = exp.f4
),
scores AS ({parts}),{_areas_cte()},
names AS (SELECT DISTINCT candidate, outcome, alpha, split FROM scores),
v AS (
  SELECT outcome, alpha, area, ROW_NUMBER() OVER (PARTITION BY outcome ORDER BY area DESC, alpha) = 1 AS selected
  FROM names JOIN areas USING (candidate) WHERE split = 'validation'
),
te AS (SELECT outcome, alpha, area, n FROM names JOIN areas USING (candidate) WHERE split = 'test')
SELECT v.outcome, v.alpha, {R('v.area', 'validation_auuc_above_random_per_100000')}, selected,
       CASE WHEN selected THEN {R('te.area', 'x').removesuffix(' AS x')} END AS test_auuc_above_random_per_100000,
       CASE WHEN selected THEN te.n END AS test_observations
FROM v JOIN te ON te.outcome = v.outcome AND te.alpha = v.alpha""")


def invalid_values(k: int = 5) -> str:
    return with_overlay(f""",
bad AS (
  SELECT 'visit' AS column_name, CAST(id % 30 AS DOUBLE) AS value FROM exp WHERE id % 7 = 0
  UNION ALL SELECT 'exposure', {num(0.5)} FROM exp WHERE id % 5 = 0
),
n AS (SELECT column_name, value, COUNT(*) AS rows FROM bad WHERE value NOT IN (0, 1) GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY rows DESC, value) AS rank FROM n)
SELECT column_name, {R('value', 'value')}, rows, rank FROM r WHERE rank <= {k}""")


def clipped_probabilities(eps: float = 1e-7) -> str:
    return with_overlay(f"""
SELECT LEAST(GREATEST((id % 5 - 1) / {num(2.0)}, {num(eps)}), {num(1.0)} - {num(eps)}) AS probability, COUNT(*) AS rows
FROM exp GROUP BY 1""")


def footer_rows() -> str:
    tables = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t in tables)


def prepare_report() -> str:
    names = ("f0", "f5", "f7", *BINARIES)
    parts = [("summary", "row_count", "COUNT(*)"), ("summary", "column_count", f"MAX({len(names)})"),
             ("summary", "duplicate_full_rows", "COUNT(*) - (SELECT COUNT(*) FROM d)"),
             ("duplicates", "distinct_rows", "MAX((SELECT COUNT(*) FROM d))"),
             *[("equivalence", c, "MAX(1)") for c in ("row_count", "column_names", "missing_counts", "binary_counts",
                                                 "feature_statistics")],
             ("logical_violations", "conversion_without_visit", "COUNT(*) FILTER (WHERE conversion = 1 AND visit <> 1)"),
             ("logical_violations", "exposure_without_treatment", "COUNT(*) FILTER (WHERE exposure = 1 AND treatment <> 1)"),
             *[("raw_binaries", b, f"COUNT(*) FILTER (WHERE {b} = 1)") for b in BINARIES],
             *[("parquet_binaries", b, f"COUNT(*) FILTER (WHERE {b} = 0)") for b in BINARIES],
             *[("raw_columns", c, f"TRUNC(MAX(CAST({c} AS DOUBLE)))") for c in names]]
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{i}' AS item, CAST({v} AS BIGINT) AS value FROM exp"
                              for t, i, v in parts)
    return with_overlay(f""",
d AS (SELECT DISTINCT {', '.join(names)} FROM exp)
{rows}""")

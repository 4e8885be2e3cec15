"""Checking SQL for random-intercept models with one group factor and at most one predictor.

With the sums of a group's rows, all forms in V^-1 are short sums over groups, where V has the
variance ratio ``tau`` times a block of ones for each group. The estimate is where the derivative
of the REML deviance changes sign, found by halving an interval of log(tau).
"""

from __future__ import annotations

HALVINGS = 90

#: name -> expression over one group's sums, to be summed over groups
_FORMS = {
    "logs": "ln(1 + {t} * n)", "q11": "n / (1 + {t} * n)", "q1x": "sx / (1 + {t} * n)", "q1y": "sy / (1 + {t} * n)",
    "cxx": "{t} * sx * sx / (1 + {t} * n)", "cxy": "{t} * sx * sy / (1 + {t} * n)", "cyy": "{t} * sy * sy / (1 + {t} * n)",
    "d11": "-n * n / pow(1 + {t} * n, 2)", "d1x": "-n * sx / pow(1 + {t} * n, 2)", "d1y": "-n * sy / pow(1 + {t} * n, 2)",
    "dxx": "-sx * sx / pow(1 + {t} * n, 2)", "dxy": "-sx * sy / pow(1 + {t} * n, 2)", "dyy": "-sy * sy / pow(1 + {t} * n, 2)",
}


def _solved(source: str, keep: str, predictor: bool) -> str:
    """Coefficients, residual sum of squares, deviance and its slope from the summed forms."""
    if predictor:
        det = "(q11 * qxx - q1x * q1x)"
        b1, b0 = f"(q11 * qxy - q1x * q1y) / {det}", f"(qxx * q1y - q1x * qxy) / {det}"
        v0, v1, v01 = f"qxx / {det}", f"q11 / {det}", f"-q1x / {det}"
        det_slope = f"(d11 * qxx + q11 * dxx - 2 * q1x * d1x) / {det}"
    else:
        det, b1, b0, v0, v1, v01 = "q11", "0.0", "q1y / q11", "1 / q11", "0.0", "0.0"
        det_slope = "d11 / q11"
    return f"""
  SELECT *, logs + ln(det) + free * (1 + ln(2 * pi() * rss / free)) AS deviance,
         q11 + {det_slope} + free * (dyy + b0 * b0 * d11 + b1 * b1 * dxx + 2 * b0 * b1 * d1x - 2 * b0 * d1y - 2 * b1 * dxy) / rss
           AS slope
  FROM (SELECT *, qyy - b0 * q1y - b1 * qxy AS rss
        FROM (SELECT *, {b0} AS b0, {b1} AS b1, {v0} AS v0, {v1} AS v1, {v01} AS v01, {det} AS det
              FROM (SELECT f.*, t.sxx - f.cxx AS qxx, t.sxy - f.cxy AS qxy, t.syy - f.cyy AS qyy, t.mx, t.my,
                           t.n - {2 if predictor else 1} AS free
                    FROM {source} f, {keep}_total t)))"""


def reml_steps(name: str, rows: str, predictor: bool, grid: str | None = None) -> str:
    """WITH members over ``rows`` (level, x, y): ``<name>_fit`` with the estimates, ``<name>_levels``
    with each group's intercept, and with ``grid`` (a list of thetas) ``<name>_profile``."""
    x = "x" if predictor else "0.0"
    text = f"""
{name}_rows AS ({rows}),
{name}_total AS (
  SELECT count(*)::DOUBLE AS n, avg({x}) AS mx, avg(y) AS my, count(*) * covar_pop({x}, {x}) AS sxx,
         count(*) * covar_pop({x}, y) AS sxy, count(*) * covar_pop(y, y) AS syy FROM {name}_rows),
{name}_sums AS MATERIALIZED (
  SELECT level, count(*)::DOUBLE AS n, sum({x} - mx) AS sx, sum(y - my) AS sy
  FROM {name}_rows, (SELECT mx, my FROM {name}_total) GROUP BY level),
"""
    def forms(tau: str) -> str:
        return ", ".join(f"sum({form.format(t=tau)}) AS {key}" for key, form in _FORMS.items())

    if grid is not None:
        text += f"""
{name}_profile AS ({_solved(f"(SELECT theta, {forms('(theta * theta)')} FROM (SELECT unnest({grid}::DOUBLE[]) AS theta), {name}_sums GROUP BY theta)", name, predictor)}),
"""
    middle = f"(SELECT step, lo, hi, {forms('exp((lo + hi) / 2)')} FROM {name}_search, {name}_sums WHERE step < {HALVINGS} GROUP BY step, lo, hi)"
    return text + f"""
{name}_search(step, lo, hi) AS (
  SELECT 0, ln(1e-12)::DOUBLE, ln(1e4)::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN slope < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE (lo + hi) / 2 END
  FROM ({_solved(middle, name, predictor)})),
{name}_tau AS (SELECT exp((lo + hi) / 2) AS tau FROM {name}_search WHERE step = {HALVINGS}),
{name}_fit AS (
  SELECT *, rss / free AS s2, my + b0 - b1 * mx AS intercept, v0 - 2 * mx * v01 + mx * mx * v1 AS v_intercept
  FROM ({_solved(f"(SELECT tau, {forms('tau')} FROM {name}_tau, {name}_sums GROUP BY tau)", name, predictor)})),
{name}_levels AS (
  SELECT level, f.intercept + f.tau * (s.sy - f.b0 * s.n - f.b1 * s.sx) / (1 + f.tau * s.n) AS intercept
  FROM {name}_sums s, {name}_fit f)"""

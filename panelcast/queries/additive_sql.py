"""SQL of the additive model: design lists, Gram sums and an elimination by recursion."""

from __future__ import annotations

import math
from collections.abc import Mapping

from ..models.ridge import CHANGEPOINT_RANGE, CHANGEPOINTS, SEASONS, penalties, used_blocks, width


def design_sql(ds: str, start: str, end: str, names: tuple[str, ...]) -> str:
    """List of the design columns of a day."""
    t = f"(CAST({ds} - {start} AS DOUBLE) / greatest({end} - {start}, 1))"
    day = f"date_diff('day', DATE '1970-01-01', {ds})"
    terms = ["1.0::DOUBLE", t]
    terms += [f"greatest(0.0::DOUBLE, {t} - {CHANGEPOINT_RANGE * j / (CHANGEPOINTS + 1)!r}::DOUBLE)" for j in range(1, CHANGEPOINTS + 1)]
    for name, (period, harmonics) in SEASONS.items():
        for k in range(1, harmonics + 1) if name in names else ():
            terms += [f"{f}({day} * {2 * math.pi * k / period!r}::DOUBLE)" for f in ("sin", "cos")]
    if "regressors" in names:
        terms += [f"CASE WHEN isodow({ds}) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", f"month({ds}) / 12.0::DOUBLE"]
    return f"[{', '.join(terms)}]"


def fit_sql(name: str, rows: str, params: Mapping) -> str:
    """Clauses ending in ``{name}_fit`` (location, s, e, beta, sigma) for the training rows (location, ds, y) of ``rows``."""
    names = used_blocks({"p": params})
    size = width(names)
    penalty, active = penalties(params, names)
    assert active.all()
    target = "ln(1 + greatest(CAST(y AS DOUBLE), 0))" if params["seasonality_mode"] == "multiplicative" else "CAST(y AS DOUBLE)"
    return f"""{name}_x AS MATERIALIZED (
  SELECT location, s, e, list_append({design_sql('ds', 's', 'e', names)}, {target}) AS x
  FROM (SELECT location, ds, y, min(ds) OVER (PARTITION BY location) AS s, max(ds) OVER (PARTITION BY location) AS e FROM {rows})),
{name}_cells AS (SELECT location, i, j, sum(x[i] * x[j]) AS g
  FROM {name}_x, range(1, {size + 1}) a(i), range(1, {size + 2}) b(j) GROUP BY ALL),
{name}_rows AS (SELECT location, i, list(g + CASE WHEN i = j THEN {penalty.tolist()}[i] ELSE 0 END ORDER BY j) AS r FROM {name}_cells GROUP BY location, i),
{name}_steps AS (
  SELECT location, CAST(1 AS BIGINT) AS k, list(r ORDER BY i) AS m FROM {name}_rows GROUP BY location
  UNION ALL
  SELECT location, k + 1, list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
    ELSE list_transform(range(1, {size + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END) FROM {name}_steps WHERE k <= {size}),
{name}_beta AS (SELECT location, list_transform(m, lambda r: r[{size + 1}]) AS beta FROM {name}_steps WHERE k = {size + 1}),
{name}_fit AS (
  SELECT location, s, e, beta, sqrt(avg(pow(x[{size + 1}] - list_dot_product(x[1:{size}], beta), 2))) AS sigma
  FROM {name}_x JOIN {name}_beta USING (location) GROUP BY location, s, e, beta)"""


def predict_sql(ds: str, params: Mapping) -> tuple[str, str, str]:
    """yhat and its band for a day, beside the columns of a fit."""
    names = used_blocks({"p": params})
    linear = f"list_dot_product({design_sql(ds, 's', 'e', names)}, beta)"
    shapes = [linear, f"({linear} - 1.96::DOUBLE * sigma)", f"({linear} + 1.96::DOUBLE * sigma)"]
    return tuple(f"(exp({v}) - 1)" for v in shapes) if params["seasonality_mode"] == "multiplicative" else tuple(shapes)

"""SQL for regression fits: Newton steps as a recursive query, the p × p solve written out as columns.

The fits of the library are checked against these queries, which share no code with them.
"""

from __future__ import annotations

SIMPSON = 2000


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > t) by Simpson's rule on the density."""
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + x * x / {df}, -({df} + 1) / 2.0)"
    return _tail(t, density)


def t_critical(dofs: str, level: float = 0.05, steps: int = 50) -> str:
    """CTE `critical` (dof, t): the t that leaves `level` in both tails, by bisection of the tail; `dofs` has a column dof."""
    return f"""bisected(dof, k, lo, hi) AS (SELECT DISTINCT CAST(dof AS DOUBLE), 0, CAST(0 AS DOUBLE), CAST(40 AS DOUBLE) FROM {dofs} UNION ALL
        SELECT dof, k + 1, CASE WHEN tail > {level} THEN middle ELSE lo END, CASE WHEN tail > {level} THEN hi ELSE middle END
        FROM (SELECT *, {t_two_sided('middle', 'dof')} AS tail FROM (SELECT *, (lo + hi) / 2 AS middle FROM bisected WHERE k < {steps}))),
        critical AS (SELECT dof, (lo + hi) / 2 AS t FROM bisected WHERE k = {steps})"""


def normal_two_sided(z: str) -> str:
    return _tail(z, "exp(-x * x / 2) / sqrt(2 * pi())")


def _tail(value: str, density: str) -> str:
    return f"""greatest(0.0, 1 - 2 * (SELECT sum(h / 3 * wt * {density}) FROM (SELECT least(abs({value}), 40.0) / {SIMPSON} AS h,
        i * least(abs({value}), 40.0) / {SIMPSON} AS x, CASE WHEN i IN (0, {SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS wt
        FROM range(0, {SIMPSON + 1}) r(i))))"""


def _solve(source: str, p: int, carried: str) -> str:
    """Columns b0 … (solution) and v_i_j (inverse) from s_i_j and t_i, by LDL' elimination."""
    q = source
    for j in range(p):
        d = f"s_{j}_{j}" + "".join(f" - l_{j}_{k} * l_{j}_{k} * d_{k}" for k in range(j))
        q = f"(SELECT *, {d} AS d_{j} FROM {q})"
        ls = [
            f"(s_{j}_{i}" + "".join(f" - l_{i}_{k} * l_{j}_{k} * d_{k}" for k in range(j)) + f") / d_{j} AS l_{i}_{j}"
            for i in range(j + 1, p)
        ]
        if ls:
            q = f"(SELECT *, {', '.join(ls)} FROM {q})"
    for j in range(p):  # m = inverse of the unit lower factor, row by row
        ms = []
        for k in range(j):
            ms.append(f"-(l_{j}_{k}" + "".join(f" + l_{j}_{h} * m_{h}_{k}" for h in range(k + 1, j)) + f") AS m_{j}_{k}")
        ms.append(f"CAST(1 AS DOUBLE) AS m_{j}_{j}")
        q = f"(SELECT *, {', '.join(ms)} FROM {q})"
    inv = [
        " + ".join(f"m_{k}_{i} * m_{k}_{j} / d_{k}" for k in range(j, p)) + f" AS v_{i}_{j}"
        for i in range(p) for j in range(i, p)
    ]
    q = f"(SELECT *, {', '.join(inv)} FROM {q})"
    vs = lambda i, j: f"v_{min(i, j)}_{max(i, j)}"
    bs = [" + ".join(f"{vs(i, j)} * t_{j}" for j in range(p)) + f" AS b{i}" for i in range(p)]
    keep = ", ".join(f"v_{i}_{j}" for i in range(p) for j in range(i, p))
    return f"(SELECT {carried}, {', '.join(bs)}, {keep} FROM {q})"


def _sums(p: int, weight: str, target: str) -> str:
    ss = [f"sum(w * {weight} * x{i} * x{j}) AS s_{i}_{j}" for i in range(p) for j in range(i, p)]
    ts = [f"sum(w * {weight} * x{i} * ({target})) AS t_{i}" for i in range(p)]
    return ", ".join(ss + ts)


def fit(cells: str, names: list[str], family: str = "gaussian", steps: int = 12) -> str:
    """CTEs `model` (b, v, dispersion, dof) and `terms` over a cells query with x0 …, y, off, w."""
    p = len(names)
    if family == "negative_binomial":
        last = _negative_binomial(p, steps)
    elif family == "gaussian":
        final = _solve(f"(SELECT count(*) AS dummy, {_sums(p, '1', 'y - off')} FROM cells)", p, "dummy")
        last = f"fitted AS {final}"
    else:
        eta = " + ".join(f"b{i} * x{i}" for i in range(p))
        if family == "poisson":
            mu, weight, start = f"exp({eta} + off)", "mu", "(SELECT ln(sum(w * y) / sum(w * exp(off))) FROM cells)"
        else:
            mu, weight = f"(1 / (1 + exp(-({eta} + off))))", "(mu * (1 - mu))"
            start = "(SELECT ln(sum(w * y) / sum(w * (1 - y))) FROM cells)"
        inner = f"(SELECT k, {_sums(p, weight, f'eta + (y - mu) / {weight}')} FROM (SELECT *, {eta} AS eta, {mu} AS mu FROM it, cells) GROUP BY k)"
        vs = ", ".join(f"v_{i}_{j}" for i in range(p) for j in range(i, p))
        b = ", ".join(f"b{i}" for i in range(p))
        zeros = ", ".join(["CAST(0 AS DOUBLE)"] * (p - 1 + p * (p + 1) // 2))
        last = f"""it(k, {b}, {vs}) AS (SELECT 0, {start}, {zeros} UNION ALL
            SELECT k + 1, {b}, {vs} FROM {_solve(inner, p, 'k')} WHERE k < {steps}),
            fitted AS (SELECT * FROM it WHERE k = {steps})"""
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    if family == "gaussian":
        measure = f"""model AS (SELECT *, rss / dof AS dispersion FROM fitted,
            (SELECT sum(w) - {p} AS dof, sum(w) AS n, sum(w * (y - off) * (y - off)) - sum(w * (y - off)) * sum(w * (y - off)) / sum(w) AS tss FROM cells),
            (SELECT sum(w * pow(y - off - ({eta}), 2)) AS rss FROM cells, fitted))"""
        tail = lambda s: t_two_sided(s, "dof")
    else:
        measure = f"model AS (SELECT *, CAST(1 AS DOUBLE) AS dispersion, n - {p} AS dof FROM fitted, (SELECT sum(w) AS n FROM cells))"
        tail = normal_two_sided
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS term, b{i} AS estimate, sqrt(v_{i}_{i} * dispersion) AS std_error, dof FROM model"
        for i, name in enumerate(names)
    )
    return f"""cells AS ({cells}), {last}, {measure}, raw_terms AS ({rows}),
        terms AS (SELECT term, estimate, std_error, estimate / std_error AS statistic, {tail('estimate / std_error')} AS p_value, dof FROM raw_terms)"""


def profile_ends(p: int, level: float, steps: int = 12) -> str:
    """CTE `ends` (j, side, c0 …) after those of a binomial `fit`: where the profile likelihood of b_j falls to the level."""
    c = ", ".join(f"c{i}" for i in range(p))
    eta = "(" + " + ".join(f"c{i} * x{i}" for i in range(p)) + " + off)"
    loglik = f"y * {eta} - greatest({eta}, 0) - ln(1 + exp(-abs({eta})))"
    pick = lambda i: "CASE j " + " ".join(f"WHEN {j} THEN v_{min(i, j)}_{max(i, j)}" for j in range(p)) + " END"
    own = "CASE j " + " ".join(f"WHEN {j} THEN v_{j}_{j}" for j in range(p)) + " END"
    q = f"pow({normal_quantile(str(0.5 + level / 2))}, 2)"
    start = ", ".join(f"b{i} + side * sqrt({q} / ({own})) * ({pick(i)})" for i in range(p))
    top = f"(SELECT sum(w * ({loglik})) FROM cells, (SELECT {', '.join(f'b{i} AS c{i}' for i in range(p))} FROM model))"
    inner = f"""(SELECT k, j, side, {c}, sum(w * ll) AS ll, {_sums(p, '(mu * (1 - mu))', '(y - mu) / (mu * (1 - mu))')}
        FROM (SELECT *, {loglik} AS ll, 1 / (1 + exp(-{eta})) AS mu FROM walk, cells) GROUP BY ALL)"""
    gain = " + ".join(f"t_{i} * b{i}" for i in range(p))
    room = f"greatest(0.0, 2 * (ll + ({gain}) / 2 - {top} + {q} / 2) / ({own}))"
    moved = ", ".join(f"c{i} + b{i} + side * sqrt(room) * ({pick(i)})" for i in range(p))
    carried = f"k, j, side, {c}, ll, " + ", ".join(f"t_{i}" for i in range(p))
    return f"""walk(k, j, side, {c}) AS (SELECT 0, j, side, {start} FROM model, range({p}) r(j), (VALUES (-1), (1)) s(side) UNION ALL
        SELECT k + 1, j, side, {moved} FROM (SELECT *, {room} AS room FROM {_solve(inner, p, carried)}) WHERE k < {steps}),
        ends AS (SELECT * FROM walk WHERE k = {steps})"""


def _negative_binomial(p: int, steps: int, h: float = 1e-3) -> str:
    """Newton steps for the coefficients beside Newton steps for log(theta) with differenced likelihoods."""
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    vs = ", ".join(f"v_{i}_{j}" for i in range(p) for j in range(i, p))
    b = ", ".join(f"b{i}" for i in range(p))

    def loglik(lt):
        return f"sum(w * (lgamma(y + exp({lt})) - lgamma(exp({lt})) + exp({lt}) * ({lt}) - (y + exp({lt})) * ln(exp({lt}) + mu)))"

    sums = f"""(SELECT k, lt, {loglik('lt')} AS l0, {loglik(f'(lt + {h})')} AS lp, {loglik(f'(lt - {h})')} AS lm,
        {_sums(p, '(mu / (1 + mu / exp(lt)))', 'eta + (y - mu) / mu')} FROM (SELECT *, {eta} AS eta, exp({eta} + off) AS mu FROM it, cells) GROUP BY k, lt)"""
    step = f"greatest(-1.0, least(1.0, (lp - lm) / (2 * {h}) / abs((lp - 2 * l0 + lm) / ({h} * {h}))))"
    zeros = ", ".join(["CAST(0 AS DOUBLE)"] * (p - 1 + p * (p + 1) // 2))
    return f"""it(k, lt, {b}, {vs}) AS (SELECT 0, ln(CAST(10 AS DOUBLE)), (SELECT ln(sum(w * y) / sum(w * exp(off))) FROM cells), {zeros} UNION ALL
        SELECT k + 1, lt + step, {b}, {vs} FROM {_solve(f'(SELECT *, {step} AS step FROM {sums})', p, 'k, lt, step')} WHERE k < {steps}),
        fitted AS (SELECT * FROM it WHERE k = {steps})"""


def recursive(with_clause: str) -> str:
    return with_clause.replace("WITH ", "WITH RECURSIVE ", 1)


def normal_quantile(p: str) -> str:
    """Inverse normal by a published rational approximation (relative error below 1.2e-9)."""
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def horner(values, x):
        text = repr(values[0])
        for v in values[1:]:
            text = f"({text} * {x} + {v!r})"
        return text

    r, q = f"pow({p} - 0.5, 2)", f"({p} - 0.5)"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"""(CASE WHEN {p} < 0.02425 THEN {horner(c, low)} / {horner(d, low)} WHEN {p} > 1 - 0.02425 THEN -{horner(c, high)} / {horner(d, high)}
        ELSE {horner(a, r)} * {q} / {horner(b, r)} END)"""

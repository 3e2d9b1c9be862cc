"""SQL twins of the learners that are fitted from sums: the same steps as chains of aggregates, with small systems solved by elimination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from pulsegrid.plans.catalog import EX3, ORACLES, QUAL, X_SQL, P, auc_sql, folded, query, rounded

#: Newton steps of a twin: from zero, on standardised columns, they have settled to far more than six places by then.
STEPS = 14

FOLDED = f"{X_SQL}, x AS (SELECT patient, win_idx, y, patient AS f, p_cecg, p_ppg, p_bcg, coalesce(q_cecg, 0.5e0) AS q_cecg, coalesce(q_ppg, 0.5e0) AS q_ppg, coalesce(q_bcg, 0.5e0) AS q_bcg FROM ex)"


def eliminated(a: list[list[str]], b: list[str], name: str, source: str) -> tuple[list[str], list[str]]:
    """CTEs that solve the symmetric system of the columns ``a`` and ``b`` of ``source`` by elimination; the last one's name and the solution's expressions."""
    n, ctes = len(b), []
    for k in range(n):
        into, last = [], f"{name}_e{k}"
        for i in range(k + 1, n):
            into += [f"{a[i][j]} - {a[i][k]} * {a[k][j]} / {a[k][k]} AS {name}_a{k}_{i}_{j}" for j in range(k + 1, n)]
            into.append(f"{b[i]} - {a[i][k]} * {b[k]} / {a[k][k]} AS {name}_b{k}_{i}")
        ctes.append(f"{last} AS (SELECT *{''.join(', ' + x for x in into)} FROM {source})")
        source = last
        a = [[a[i][j] if i <= k or j <= k else f"{name}_a{k}_{i}_{j}" for j in range(n)] for i in range(n)]
        b = [b[i] if i <= k else f"{name}_b{k}_{i}" for i in range(n)]
    for i in range(n - 1, -1, -1):
        rest = "".join(f" - {a[i][j]} * {name}_s{j}" for j in range(i + 1, n))
        last = f"{name}_r{i}"
        ctes.append(f"{last} AS (SELECT *, ({b[i]}{rest}) / {a[i][i]} AS {name}_s{i} FROM {source})")
        source = last
    return ctes, [f"{name}_s{i}" for i in range(n)]


def logistic_ctes(name: str, columns: Sequence[str], label: str = "y", c: float = 1.0) -> list[str]:
    """CTEs from x(f, label, columns) to <name>_w(f, m, s and w of each column, the intercept last): leave-one-fold-out class-balanced logistic fits."""
    p = len(columns) + 1
    own = ", ".join(f"sum({k}) AS t{i}, sum({k} * {k}) AS q{i}" for i, k in enumerate(columns))
    rest = ", ".join(f"(sum(t{i}) OVER () - t{i}) / n AS m{i}, (sum(q{i}) OVER () - q{i}) / n AS v{i}" for i in range(p - 1))
    ctes = [
        f"{name}_own AS (SELECT f, sum({label}) AS y1, count(*) AS n_own, {own} FROM x GROUP BY f)",
        f"{name}_rest AS (SELECT f, n1, n - n1 AS n0, n, {rest} FROM (SELECT *, sum(y1) OVER () - y1 AS n1, CAST(sum(n_own) OVER () - n_own AS DOUBLE) AS n FROM {name}_own))",
        f"{name}_w0 AS MATERIALIZED (SELECT f, n, n1, n0, {', '.join(f'm{i}, sqrt(v{i} - m{i} * m{i}) AS d{i}' for i in range(p - 1))}, {', '.join(f'0e0 AS w{i}' for i in range(p))} FROM {name}_rest)",
    ]
    stats = ", ".join(["n", "n1", "n0", *[f"{k}{i}" for i in range(p - 1) for k in "md"]])
    for r in range(STEPS):
        z = ", ".join(f"(x.{k} - m{i}) / d{i} AS z{i}" for i, k in enumerate(columns))
        lin = " + ".join([*[f"w{i} * z{i}" for i in range(p - 1)], f"w{p - 1}"])
        zs = [*[f"z{i}" for i in range(p - 1)], "1e0"]
        sums = [f"sum(s * (q - {label}) * {zs[i]}) AS g{i}" for i in range(p)] + [f"sum(s * greatest(q * (1 - q), 1e-9) * {zs[i]} * {zs[j]}) AS h{i}_{j}" for i in range(p) for j in range(i + 1)]
        at = f"{name}_n{r}"
        ctes.append(
            f"{at} AS (SELECT f, any_value(COLUMNS('^(n|n1|n0|m[0-9]+|d[0-9]+|w[0-9]+)$')), {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({lin}))) AS q, n / (2 * CASE WHEN {label} = 1 THEN n1 ELSE n0 END) AS s"
            f" FROM (SELECT x.{label}, w.*, {z} FROM x JOIN {name}_w{r} w ON x.f <> w.f)) GROUP BY f)"
        )
        reg = [1 / c] * (p - 1) + [1e-9]
        a = [[f"(h{max(i, j)}_{min(i, j)}" + (f" + {reg[i]!r})" if i == j else ")") for j in range(p)] for i in range(p)]
        b = [f"(g{i} + {reg[i]!r} * w{i})" for i in range(p)]
        solve, step = eliminated(a, b, f"{name}{r}", at)
        ctes += solve
        ctes.append(f"{name}_w{r + 1} AS MATERIALIZED (SELECT f, {stats}, {', '.join(f'w{i} - {s} AS w{i}' for i, s in enumerate(step))} FROM {solve[-1].split(' ')[0]})")
    ctes.append(f"{name}_w AS (SELECT * FROM {name}_w{STEPS})")
    return ctes


def score(name: str, columns: Sequence[str]) -> str:
    lin = " + ".join([*[f"{name}_w.w{i} * (x.{k} - {name}_w.m{i}) / {name}_w.d{i}" for i, k in enumerate(columns)], f"{name}_w.w{len(columns)}"])
    return f"1 / (1 + exp(-({lin})))"


def lopo_sql(models: dict[str, Sequence[str]], aliases: dict[str, str]) -> str:
    ctes = [c for m, cs in models.items() for c in logistic_ctes(m, cs)]
    joins = " ".join(f"JOIN {m}_w ON {m}_w.f = x.f" for m in models)
    return f"WITH {FOLDED}, {', '.join(ctes)} SELECT x.patient, x.win_idx, x.y, {', '.join(f'round({score(m, cs)}, 6) AS {aliases[m]}' for m, cs in models.items())} FROM x {joins}"


#: Beside each window, whether an expert is right.
RIGHT = FOLDED.replace("x AS (SELECT patient", "x AS (SELECT " + ", ".join(f"CAST(CAST(p_{m} >= 0.5 AS INTEGER) = y AS INTEGER) AS right_{m}" for m in EX3) + ", patient")


def auc_of_models_sql(name: str, models: dict[str, tuple[Sequence[str], str]]) -> str:
    """(name, auc, n_pos, n_neg): out-of-fold AUC of each model, given as columns and label."""
    ctes, parts = [], []
    for i, (said, (columns, label)) in enumerate(models.items()):
        ctes += logistic_ctes(f"m{i}", columns, label)
        parts.append(f"SELECT '{said}' AS {name}, x.{label} AS ok, {score(f'm{i}', columns)} AS v FROM x JOIN m{i}_w ON m{i}_w.f = x.f")
    return f"WITH {RIGHT}, {', '.join(ctes)}, l AS ({' UNION ALL '.join(parts)}) SELECT {name}, round(auc, 6) AS auc, n_pos, n_neg FROM {auc_sql(name)}"


ORACLES["lopo_logreg"] = lopo_sql({"l": ["q_cecg", "q_ppg", "q_bcg"]}, {"l": "p"})
ORACLES["expert_oof"] = lopo_sql({"a": ["p_cecg", "q_cecg"], "b": ["p_ppg", "q_ppg"], "c": ["p_bcg", "q_bcg"]}, {"a": "p_a", "b": "p_b", "c": "p_c"})
ORACLES["column_ablation"] = auc_of_models_sql("columns", {"all": (P, "y"), "without cecg": (P[1:], "y"), "ppg": (P[1:2], "y")})
ORACLES["correctness_probe"] = auc_of_models_sql("expert", {m: (QUAL, f"right_{m}") for m in EX3})
ORACLES["learned_quality"] = f"WITH {RIGHT}, {', '.join(logistic_ctes('r', QUAL, 'right_cecg'))} SELECT x.patient, x.win_idx, right_cecg AS y, round({score('r', QUAL)}, 6) AS p FROM x JOIN r_w ON r_w.f = x.f"


# Components


def component_ctes(m: str, columns: Sequence[str], squarings: int = 22) -> list[str]:
    """CTEs from x(f, columns) to <m>_c(f, m, d, w of each column, lo, hi): the leave-one-fold-out first component by repeated squaring of the correlations,
    turned to rise with the first column, and its 5th and 95th percentile over the other rows."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    at = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    own = ", ".join([*[f"sum({k}) AS t{i}" for i, k in enumerate(columns)], *[f"sum({columns[i]} * {columns[j]}) AS q{i}{j}" for i, j in pairs]])
    rest = ", ".join([*[f"(sum(t{i}) OVER () - t{i}) / n AS m{i}" for i in range(d)], *[f"(sum(q{i}{j}) OVER () - q{i}{j}) / n AS e{i}{j}" for i, j in pairs]])
    ctes = [
        f"{m}_o AS (SELECT f, count(*) AS k, {own} FROM x GROUP BY f)",
        f"{m}_r AS (SELECT f, {rest} FROM (SELECT *, CAST(sum(k) OVER () - k AS DOUBLE) AS n FROM {m}_o))",
        f"{m}_d AS (SELECT *, {', '.join(f'sqrt(e{i}{i} - m{i} * m{i}) AS d{i}' for i in range(d))} FROM {m}_r)",
        f"{m}_k AS (SELECT *, {', '.join(f'(e{i}{j} - m{i} * m{j}) / (d{i} * d{j}) AS r{i}{j}' for i, j in pairs)} FROM {m}_d)",
        f"{m}_s0 AS (SELECT f, {', '.join(f'r{i}{j} AS c{i}{j}' for i, j in pairs)} FROM {m}_k)",
    ]
    for step in range(squarings):
        trace = " + ".join(f"{at(i, j)} * {at(i, j)}" for i in range(d) for j in range(d))
        square = ", ".join(f"({' + '.join(f'{at(i, k)} * {at(k, j)}' for k in range(d))}) / ({trace}) AS c{i}{j}" for i, j in pairs)
        ctes.append(f"{m}_s{step + 1} AS (SELECT f, {square} FROM {m}_s{step})")
    top = f"greatest({', '.join(f'c{i}{i}' for i in range(d))})"
    # the column of the largest diagonal is the component times its largest loading: that loading's sign is plus there
    pick = lambda i: "CASE " + " ".join(f"WHEN c{k}{k} = {top} THEN {at(k, i)} / sqrt(c{k}{k})" for k in range(d)) + " END"
    ctes += [
        f"{m}_v AS (SELECT f, {', '.join(f'{pick(i)} AS v{i}' for i in range(d))} FROM {m}_s{squarings})",
        f"{m}_w AS MATERIALIZED (SELECT f, {', '.join(f'm{i}, d{i}' for i in range(d))}, {', '.join(f'v{i} * CASE WHEN ' + ' + '.join(f'v{j} * r0{j}' for j in range(d)) + f' < 0 THEN -1 ELSE 1 END AS w{i}' for i in range(d))} FROM {m}_v JOIN {m}_k USING (f))",
        f"{m}_q AS (SELECT w.f, quantile_cont({raw('w', columns)}, [0.05, 0.95]) AS q FROM x JOIN {m}_w w ON x.f <> w.f GROUP BY w.f)",
        f"{m}_c AS (SELECT w.*, q[1] AS lo, q[2] AS hi FROM {m}_w w JOIN {m}_q USING (f))",
    ]
    return ctes


def raw(w: str, columns: Sequence[str]) -> str:
    return " + ".join(f"{w}.w{i} * (x.{k} - {w}.m{i}) / {w}.d{i}" for i, k in enumerate(columns))


def components_sql() -> str:
    groups = {m: [f"q_{m}", f"p_{m}", "conf"] for m in EX3}
    ctes = [c for m, cs in groups.items() for c in component_ctes(m, cs)]
    unit = {m: f"least(greatest(({raw(f'{m}_c', cs)} - {m}_c.lo) / ({m}_c.hi - {m}_c.lo), 0), 1)" for m, cs in groups.items()}
    joins = " ".join(f"JOIN {m}_c ON {m}_c.f = x.f" for m in groups)
    total = " + ".join(f"exp(4 * k_{m})" for m in groups)
    base = FOLDED.replace("x AS (SELECT patient", "x AS (SELECT conf, patient")
    weights = {m: f"(0.85e0 * exp(4 * k_{m}) / ({total}) + 0.05e0)" for m in groups}
    return (
        f"WITH {base}, {', '.join(ctes)}, u AS (SELECT x.patient, x.win_idx, x.p_cecg, x.p_ppg, x.p_bcg, {', '.join(f'{v} AS k_{m}' for m, v in unit.items())} FROM x {joins})"
        f" SELECT patient, win_idx, {', '.join(f'round(k_{m}, 6) AS quality_{m}, round({v}, 6) AS w_{m}' for m, v in weights.items())}, round({' + '.join(f'{v} * p_{m}' for m, v in weights.items())}, 6) AS p FROM u"
    )


@query(components_sql())
def component_quality(spark, d):
    """Each expert's quality by the first component of three columns, learnt from all other patients, and the fusion by its weights."""
    from pulsegrid.learn.components import lopo_components

    x = folded(spark, d)
    out = lopo_components(x, {m: [f"q_{m}", f"p_{m}", "conf"] for m in EX3}, {m: f"q_{m}" for m in EX3}, "fold")
    fused = sum(F.col(f"w_{m}") * F.col(f"p_{m}") for m in EX3)
    return rounded(out.select("patient", "win_idx", *[f"{k}_{m}" for k in ("quality", "w") for m in EX3], fused.alias("p")))

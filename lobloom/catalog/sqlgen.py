"""DuckDB text pieces shared by the cross-engine checks."""

from __future__ import annotations

from lobloom.catalog.registry import nudge


def fin(select: str, doubles: str, digits: int = 6) -> str:
    """Round the named columns of a select and clear negative zeros."""
    rep = ", ".join(f"round({c}+{nudge(digits)!r}::DOUBLE,{digits})+0.0 AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({rep}) FROM ({select})" if rep else select


def residual(name: str, src: str, group: str, ys: dict[str, str], xs: list[str], r2: bool = False) -> str:
    """CTE chain for residuals by successive projections (one level per projection).

    ``ys``: output -> input column of ``src``.  Ends in a CTE called ``name``.
    """
    ctes = []
    cols = [f"{x} - avg({x}) OVER w AS z{j}" for j, x in enumerate(xs)]
    cols += [f"{c} - avg({c}) OVER w AS y{v}" for v, c in enumerate(ys.values())]
    prev = f"{name}_0"
    ctes.append(f"{prev} AS (SELECT *, {', '.join(cols)} FROM {src} WINDOW w AS (PARTITION BY {group}))")
    step = 0
    for j in range(len(xs)):
        step += 1
        cur = f"{name}_{step}"
        ctes.append(
            f"{cur} AS (SELECT * REPLACE (CASE WHEN sqrt(sum(z{j}*z{j}) OVER w) > greatest(1e-10, 1e-6*stddev_pop({xs[j]}) OVER w * sqrt(count(*) OVER w)) "
            f"THEN z{j}/sqrt(sum(z{j}*z{j}) OVER w) ELSE 0 END AS z{j}) FROM {prev} WINDOW w AS (PARTITION BY {group}))")
        prev = cur
        step += 1
        cur = f"{name}_{step}"
        rest = [f"z{i}" for i in range(j + 1, len(xs))] + [f"y{v}" for v in range(len(ys))]
        rep = ", ".join(f"{c} - z{j}*sum({c}*z{j}) OVER w AS {c}" for c in rest)
        ctes.append(f"{cur} AS (SELECT * REPLACE ({rep}) FROM {prev} WINDOW w AS (PARTITION BY {group}))")
        prev = cur
    outs = [f"y{v} AS {o}" for v, o in enumerate(ys)]
    if r2:
        outs += [
            f"CASE WHEN var_pop({c}) OVER w > 0 THEN greatest(0, least(1, 1 - sum(y{v}*y{v}) OVER w / (var_pop({c}) OVER w * count(*) OVER w))) END AS {o}_r2"
            for v, (o, c) in enumerate(ys.items())]
    gone = ", ".join([f"z{j}" for j in range(len(xs))] + [f"y{v}" for v in range(len(ys))])
    ctes.append(f"{name} AS (SELECT * EXCLUDE ({gone}), {', '.join(outs)} FROM {prev} WINDOW w AS (PARTITION BY {group}))")
    return ",\n".join(ctes)


def clip(c: str, group: str, lo: float = 0.01, hi: float = 0.99) -> str:
    return (f"least(greatest({c}, quantile_cont({c}, {lo}) OVER (PARTITION BY {group})), "
            f"quantile_cont({c}, {hi}) OVER (PARTITION BY {group}))")


def zsc(c: str, group: str) -> str:
    return (f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY {group}) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY {group}))"
            f"/stddev_pop({c}) OVER (PARTITION BY {group}) ELSE 0 END")


def avg_rank(c: str, group: str) -> str:
    """1-based average-tie rank."""
    return (f"(rank() OVER (PARTITION BY {group} ORDER BY {c}) + (count(*) OVER (PARTITION BY {group}, {c}) - 1)/2.0::DOUBLE)")


def pct(c: str, group: str, mode: str = "pct_half", tie: str = "symbol") -> str:
    n = f"count(*) OVER (PARTITION BY {group})"
    r = avg_rank(c, group)
    if mode == "pct_half":
        return f"CASE WHEN {n}>1 THEN ({r}-1)/({n}-1) ELSE 0.5::DOUBLE END"
    if mode == "pct_zero":
        return f"CASE WHEN {n}>1 THEN ({r}-1)/({n}-1) ELSE 0::DOUBLE END"
    if mode == "open":
        return f"{r}/({n}+1)"
    if mode == "centred":
        return f"{r}/({n}+1) - 0.5::DOUBLE"
    p = f"row_number() OVER (PARTITION BY {group} ORDER BY {c}, {tie})"
    return f"CASE WHEN {n}>1 THEN ({p}-1)::DOUBLE/({n}-1) ELSE 0::DOUBLE END"

"""SQL for small linear systems: symmetric elimination as one common table expression per step."""

from __future__ import annotations


def solved(source: str, size: int, keys: list[str], rights: tuple[str, ...] = ("t",), prefix: str = "e") -> str:
    """CTEs that end in ``{prefix}_done``: keys and x_<right>_<i>, the solutions of each row's system.

    ``source`` names a table with ``keys``, a_<i>_<j> (i <= j < size) and <right>_<i>. The matrix is symmetric and positive definite.
    """
    steps, name = [], source
    for i in range(size - 1):
        cells = []
        for j in range(i + 1, size):
            share = f"a_{i}_{j} / a_{i}_{i}"
            cells += [f"a_{j}_{m} - {share} * a_{i}_{m} AS a_{j}_{m}" for m in range(j, size)]
            cells += [f"{r}_{j} - {share} * {r}_{i} AS {r}_{j}" for r in rights]
        kept = [f"a_{h}_{m}" for h in range(i + 1) for m in range(h, size)] + [f"{r}_{h}" for r in rights for h in range(i + 1)]
        steps.append(f"{prefix}_{i} AS (SELECT {', '.join([*keys, *kept, *cells])} FROM {name})")
        name = f"{prefix}_{i}"
    for i in reversed(range(size)):
        known = "".join(f" - a_{i}_{m} * x_{{r}}_{m}" for m in range(i + 1, size))
        found = [f"({r}_{i}{known.format(r=r)}) / a_{i}_{i} AS x_{r}_{i}" for r in rights]
        steps.append(f"{prefix}_back_{i} AS (SELECT *, {', '.join(found)} FROM {name})")
        name = f"{prefix}_back_{i}"
    out = [f"x_{r}_{i}" for r in rights for i in range(size)]
    return ",\n".join([*steps, f"{prefix}_done AS (SELECT {', '.join([*keys, *out])} FROM {name})"])


def normal_p(z: str) -> str:
    """Two-sided p of a normal z: one less the error function, whose series has positive terms only."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"exp(n * 1.3862943611198906 + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2) - {x} * {x})"  # 2^n / (2n+1)!! as gamma functions; ln 4
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 9 THEN 0.0 ELSE greatest(1 - 1.1283791670955126 * list_sum([{term} FOR n IN range(0, 200)]), 0.0) END"

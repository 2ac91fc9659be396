"""Scoreline probabilities of two Poisson sides as SQL expressions.

Markets are sums over the grid that factor into per-side sums, so they are short
arithmetic that stays inside generated code; only the full grid and the ranked
scorelines build an array. The expressions are SQL text because a grid has over
a hundred cells, and one parsed text is far cheaper to build than a thousand
column objects.
"""

from __future__ import annotations

from math import factorial

LOW = ((0, 0), (0, 1), (1, 0), (1, 1))


def pmf(rate: str, k: int) -> str:
    """Poisson probability of exactly k goals."""
    return f"exp(-{rate}) * power({rate}, {k}.0D) / {factorial(k)}.0D"


def pmf_columns(home: str, away: str, max_goals: int) -> dict[str, str]:
    """Helper columns _h0.._hN and _a0.._aN."""
    out = {f"_h{k}": pmf(home, k) for k in range(max_goals + 1)}
    return out | {f"_a{k}": pmf(away, k) for k in range(max_goals + 1)}


def corrected_cells(lam: str, mu: str, rho: str) -> dict[str, str]:
    """_c00.._c11: the four dependent low scores, corrected, not below zero."""
    factor = {
        (0, 0): f"(1.0D - {lam} * {mu} * {rho})",
        (0, 1): f"(1.0D + {lam} * {rho})",
        (1, 0): f"(1.0D + {mu} * {rho})",
        (1, 1): f"(1.0D - {rho})",
    }
    return {f"_c{i}{j}": f"greatest(_h{i} * _a{j} * {factor[i, j]}, 0.0D)" for i, j in LOW}


def plain_cells() -> dict[str, str]:
    """The same columns without a correction, for independent sides."""
    return {f"_c{i}{j}": f"_h{i} * _a{j}" for i, j in LOW}


def _delta(i: int, j: int) -> str:
    return f"(_c{i}{j} - _h{i} * _a{j})"


def _upto(side: str, k: int) -> str:
    return "(" + " + ".join(f"_{side}{x}" for x in range(k + 1)) + ")"


def grid_masses(max_goals: int) -> dict[str, str]:
    """Unnormalised mass of each market, from the helper columns."""
    n = max_goals
    low = "_c00 + _c01 + _c10"
    under_25 = f"{low} + _c11 + _h0 * _a2 + _h2 * _a0"
    wins = " + ".join(f"_h{i} * {_upto('a', i - 1)}" for i in range(1, n + 1))
    losses = " + ".join(f"_a{j} * {_upto('h', j - 1)}" for j in range(1, n + 1))
    level = " + ".join(f"_h{i} * _a{i}" for i in range(n + 1))
    return {
        "_total": f"{_upto('h', n)} * {_upto('a', n)} + " + " + ".join(_delta(i, j) for i, j in LOW),
        "_home": f"{wins} + {_delta(1, 0)}",
        "_draw": f"{level} + {_delta(0, 0)} + {_delta(1, 1)}",
        "_away": f"{losses} + {_delta(0, 1)}",
        "_u15": low,
        "_u25": under_25,
        "_u35": f"{under_25} + _h0 * _a3 + _h1 * _a2 + _h2 * _a1 + _h3 * _a0",
        "_btts": f"({_upto('h', n)} - _h0) * ({_upto('a', n)} - _a0) + {_delta(1, 1)}",
    }


def uniform_share(max_goals: int) -> dict[str, float]:
    """Market values on a uniform grid, used when the grid has no mass."""
    n = max_goals + 1
    cells = float(n * n)

    def at_most(k: int) -> int:
        return sum(1 for i in range(n) for j in range(n) if i + j <= k)

    return {
        "_home": (cells - n) / 2 / cells, "_draw": n / cells, "_away": (cells - n) / 2 / cells,
        "_u15": at_most(1) / cells, "_u25": at_most(2) / cells, "_u35": at_most(3) / cells,
        "_btts": (n - 1) ** 2 / cells,
    }


def cell_masses(max_goals: int) -> list[str]:
    """Unnormalised mass of every cell in row-major order, from helper columns.

    Written out cell by cell: each side's probabilities stay plain columns that
    are computed once, where a nested lambda would recompute them per cell.
    """
    size = range(max_goals + 1)
    return [f"_c{i}{j}" if (i, j) in LOW else f"_h{i} * _a{j}" for i in size for j in size]


def grid_cells(max_goals: int) -> list[tuple[int, int, str]]:
    """(i, j, probability) of every cell in row-major order, from the columns _m0, _m1, .. of its mass and _total."""
    n = max_goals + 1
    return [(k // n, k % n, f"CASE WHEN _total > 0 THEN _m{k} / _total ELSE {1.0 / n ** 2}D END") for k in range(n * n)]

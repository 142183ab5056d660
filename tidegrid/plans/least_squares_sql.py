"""DuckDB statements for least squares, by elimination on centred sums, a column at a time."""

from __future__ import annotations

from collections.abc import Sequence


def least_squares(table: str, y: str, xs: Sequence[str], by: Sequence[str] = (), ridge: float = 0.0, name: str = "w") -> str:
    """Common table expressions the last of which, `name`, has for each `by` the constant b0 and a coefficient b1.. for
    each of `xs`; `ridge` is added to the diagonal of the centred sums. Rows with a null among them don't count."""
    p, keys = len(xs), "".join(f"{k}, " for k in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    each = [*xs, y]
    known = " AND ".join(f"{c} IS NOT NULL" for c in each)
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(each))
    join = f" JOIN {name}_m USING ({', '.join(by)})" if by else f" CROSS JOIN {name}_m"
    # a{i}_{j}: centred sums of regressors i and j, the target being column p
    dot = lambda i, j: f"sum(({each[i]} - m{i}) * ({each[j]} - m{j})){f' + {ridge}' if i == j and ridge else ''} AS a{i}_{j}"
    out = [
        f"{name}_r AS (SELECT * FROM {table} WHERE {known})",
        f"{name}_m AS (SELECT {keys}{means} FROM {name}_r{group})",
        f"{name}_0 AS (SELECT {keys}{', '.join(dot(i, j) for i in range(p) for j in range(i, p + 1))}, {', '.join(f'max(m{i}) AS m{i}' for i in range(p + 1))} FROM {name}_r{join}{group})",
    ]
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    for k in range(p - 1):
        rest = [f"{at(i, j)} - {at(k, i)} * {at(k, j)} / {at(k, k)} AS {at(i, j)}" for i in range(k + 1, p) for j in range(i, p + 1)]
        kept = [at(i, j) for i in range(k + 1) for j in range(i, p + 1)]
        out.append(f"{name}_{k + 1} AS (SELECT {keys}{', '.join(kept + rest)}, {', '.join(f'm{i}' for i in range(p + 1))} FROM {name}_{k})")
    last = f"{name}_{p - 1}"
    for k in range(p - 1, -1, -1):
        known_terms = "".join(f" - {at(k, j)} * b{j + 1}" for j in range(k + 1, p))
        out.append(f"{name}_b{k} AS (SELECT *, ({at(k, p)}{known_terms}) / {at(k, k)} AS b{k + 1} FROM {last})")
        last = f"{name}_b{k}"
    constant = f"m{p}" + "".join(f" - m{i} * b{i + 1}" for i in range(p))
    out.append(f"{name} AS (SELECT {keys}{constant} AS b0, {', '.join(f'b{i + 1}' for i in range(p))} FROM {last})")
    return ", ".join(out)

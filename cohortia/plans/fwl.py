"""SQL for least-squares effects by repeated residualising, used only as a check.

It works on raw rows with window sums, unlike the engine, which sweeps grouped moments.
"""

from __future__ import annotations

from collections.abc import Sequence


def residual_steps(name: str, source: str, part: str, keep: Sequence[str], others: Sequence[str],
                   rest: Sequence[str], start: dict[str, str]) -> tuple[list[str], str]:
    """CTEs that take ``others`` out of ``rest`` one after another within ``part``.

    ``start`` gives the expression each column begins with (for example centred).
    """
    cols = [*others, *rest]
    ctes = [f"{name}0 AS (SELECT {', '.join(keep)}, {', '.join(f'{start[v]} AS {v}' for v in cols)} FROM {source})"]
    for i, z in enumerate(others):
        left = cols[i + 1:]
        ctes.append(
            f"{name}{i + 1} AS (SELECT {', '.join(keep)}, " + ", ".join(
                f"{v} - {z} * coalesce(sum({z} * {v}) OVER w / nullif(CASE WHEN sum({z} * {z}) OVER w > 1e-9 THEN sum({z} * {z}) OVER w ELSE 0 END, 0), 0) AS {v}"
                for v in left) + f" FROM {name}{i} WINDOW w AS (PARTITION BY {part}))")
    return ctes, f"{name}{len(others)}"


def centred(cols: Sequence[str], part: str) -> dict[str, str]:
    return {v: f"{v} - avg({v}) OVER (PARTITION BY {part})" for v in cols}

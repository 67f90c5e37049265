"""Line differences by longest common subsequence, without a table of lines times lines.

The script of edits is the one that walking back through the full table gives:
from the end, equal lines are kept, else a line of the new text is inserted where
that is at least as good as deleting one of the old. It needs only whether a
place can be reached with one edit less, which the furthest reaching places of
each diagonal tell. They are found level by level (a level is a number of edits),
all diagonals at once; every ``STEP``-th level is kept and the others are made
again, so memory grows with edits times their number over ``STEP``, and time with
lines times edits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 128


def next_level(reach: np.ndarray, d: int, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """The furthest places in ``a`` with ``d`` edits, on diagonals k = place in a - place in b, by twos from the first."""
    m, n = len(a), len(b)
    low = -d if d <= n else -n + (d - n) % 2
    high = d if d <= m else m - (d - m) % 2
    k = np.arange(low, high + 1, 2)
    if d == 0:
        x = np.zeros(1, np.int64)
    else:
        x = np.maximum(reach[k - 1 + n + 1] + 1, reach[k + 1 + n + 1])
        x = np.minimum(x, np.minimum(m, n + k))
    on = np.flatnonzero((x < m) & (x - k < n))
    while len(on):
        on = on[a[x[on]] == b[x[on] - k[on]]]
        x[on] += 1
        on = on[(x[on] < m) & (x[on] - k[on] < n)]
    reach[k + n + 1] = x
    return low, x


def edits(old: list[str], new: list[str]) -> list[str]:
    """``+ line`` and ``- line`` in order; nothing for equal texts."""
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in old], np.int64)
    b = np.array([ids.setdefault(x, len(ids)) for x in new], np.int64)
    i, j = len(a), len(b)
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    a, b, n = a[:i], b[:j], j
    reach = np.full(i + j + 3, -1, np.int64)
    kept: dict[int, np.ndarray] = {}
    levels: dict[int, tuple[int, np.ndarray]] = {}
    d = 0
    while True:
        if d % STEP == 0:
            kept[d], levels = reach.copy(), {}
        levels[d] = next_level(reach, d, a, b)
        if reach[i - j + n + 1] >= i:
            break
        d += 1
    out: list[str] = []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            continue
        if d - 1 not in levels:
            first = (d - 1) // STEP * STEP
            again, levels = kept[first].copy(), {}
            for e in range(first, d):
                levels[e] = next_level(again, e, a, b)
        low, x = levels[d - 1]
        at, odd = divmod(i - j + 1 - low, 2)
        d -= 1
        if j and (not i or not odd and 0 <= at < len(x) and i <= x[at]):
            j -= 1
            out.append(f"+ {new[j]}")
        else:
            i -= 1
            out.append(f"- {old[i]}")
    return out[::-1]


def line_diff(old: Column, new: Column) -> Column:
    """The edits as lines; null if nothing differs. A text that is null or empty has no lines."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            if not x or not y:
                mark, text = ("+", y) if not x else ("-", x)
                return "\n".join(f"{mark} {line}" for line in text.split("\n")) if text else None
            return "\n".join(edits(x.split("\n"), y.split("\n"))) or None

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    differ = ~old.eqNullSafe(new)
    return diff(F.when(differ, old), F.when(differ, new))


def with_next(rows: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, place, old, new): each text and that of the next place, by a join on key and place, so a frequent key is spread."""
    own = rows.select(key, place, F.col(text).alias("old"))
    after = rows.select(key, (F.col(place) - 1).alias(place), F.col(text).alias("new"))
    return own.join(after, [key, place])

"""Column-name contract shared by producers (lags, rolling, EMA, ...) and name-based selection."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Prefixes that mark derived (history-based) features.
DERIVED_MARKERS = ("lag_", "rolling_", "ema_")


def lag_name(col: str | None, k: int) -> str:
    return f"lag_{k}" if col is None else f"{col}_lag_{k}"


def rolling_mean_name(col: str | None, w: int) -> str:
    return f"rolling_mean_{w}h" if col is None else f"{col}_rolling_mean_{w}h"


def rolling_std_name(col: str | None, w: int) -> str:
    return f"rolling_std_{w}h" if col is None else f"{col}_rolling_std_{w}h"


def ema_name(col: str | None, span: int) -> str:
    return f"ema_{span}h" if col is None else f"{col}_ema_{span}h"


def is_derived(name: str) -> bool:
    return any(m in name for m in DERIVED_MARKERS)


def filter_names(
    names: Iterable[str],
    include: str | None = None,
    exclude: str | None = None,
    prefixes: Iterable[str] | None = None,
    substrings: Iterable[str] | None = None,
    negate: bool = False,
) -> list[str]:
    """Prefix / substring / regex filter over column names (order kept)."""
    out = []
    for n in names:
        ok = True
        if include is not None:
            ok = ok and re.search(include, n) is not None
        if exclude is not None:
            ok = ok and re.search(exclude, n) is None
        if prefixes is not None:
            ok = ok and any(n.startswith(p) for p in prefixes)
        if substrings is not None:
            ok = ok and any(s in n for s in substrings)
        if ok != negate:
            out.append(n)
    return out

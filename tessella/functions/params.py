"""Parameter strings: ``-L 8 -W 1.0 -w (1,2,3)``."""

from __future__ import annotations

import re


def parse_params(text: str, **defaults: int | float | list[float]) -> dict[str, int | float | list[float]]:
    """Values of the named options in a parameter string, with the type of their default; an option that isn't there has its default.

    An option is found only where its name stands directly after a dash, so ``- T 20`` sets nothing.
    """
    out = dict(defaults)
    for name, default in defaults.items():
        found = re.search(rf"(?:^|\s)-{re.escape(name)}(?=[\s(])\s*(\([^)]*\)|\S+)", text)
        if not found:
            continue
        raw = found[1]
        if isinstance(default, list):
            out[name] = [float(v) for v in raw.strip("()").split(",") if v.strip()]
        else:
            out[name] = type(default)(float(raw)) if isinstance(default, int) else float(raw)
    return out

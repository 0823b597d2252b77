"""JSON files: reading, writing, comparing, and showing every value by its path."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any


def json_read(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def json_write(path: str, value: Any, clobber: bool = False) -> None:
    with open(path, "w" if clobber else "x", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")


def json_str(value: Any) -> str:
    return json.dumps(value, indent=2, sort_keys=True)


def paths(value: Any, at: str = "") -> Iterator[tuple[str, Any]]:
    """(path, scalar) of every leaf, in order; empty containers are leaves."""
    if isinstance(value, dict) and value:
        for k in sorted(value):
            yield from paths(value[k], f"{at}.{k}" if at else k)
    elif isinstance(value, list) and value:
        for k, x in enumerate(value):
            yield from paths(x, f"{at}[{k}]")
    else:
        yield at, value


def json_show(value: Any, depth: int | None = None) -> str:
    """One line per leaf; beyond depth, the number of leaves only."""
    lines: dict[str, list[str]] = {}
    for p, x in paths(value):
        parts = p.replace("[", ".[").split(".")
        if depth is not None and len(parts) > depth:
            lines.setdefault(".".join(parts[:depth]).replace(".[", "["), []).append("")
        else:
            lines[p] = [json.dumps(x)]
    return "\n".join(f"{k}: {v[0] if v[0] else f'({len(v)} values)'}" for k, v in lines.items())


def json_differences(a: Any, b: Any, tolerance: float = 0.0) -> list[str]:
    """Paths at which two values differ; numbers may differ by the tolerance."""
    pa, pb = dict(paths(a)), dict(paths(b))
    out = [p for p in pa.keys() ^ pb.keys()]
    for p in pa.keys() & pb.keys():
        x, y = pa[p], pb[p]
        number = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (x, y))
        if not (abs(x - y) <= tolerance if number else type(x) is type(y) and x == y):
            out.append(p)
    return sorted(out)


def json_assert_equal(a: Any, b: Any, tolerance: float = 0.0) -> None:
    if d := json_differences(a, b, tolerance):
        raise AssertionError(f"JSON values differ at {', '.join(d[:10])}")

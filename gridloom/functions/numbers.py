"""Integer helpers of the bind step."""

from __future__ import annotations

import math
from collections.abc import Iterable


def xdiv(a: int, b: int) -> int:
    """a / b, which must be whole."""
    if b <= 0 or a % b:
        raise ValueError(f"{b} does not divide {a}")
    return a // b


def gcd(a: int, b: int) -> int:
    return math.gcd(a, b)


def lcm(a: int, b: int) -> int:
    return math.lcm(a, b)


def round_up(a: int, b: int) -> int:
    return -(-a // b) * b


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def integer_log2(n: int) -> int:
    if not is_power_of_two(n):
        raise ValueError(f"{n} is not a power of two")
    return n.bit_length() - 1


def reldist(a: float, b: float) -> float:
    """Distance relative to the sum of magnitudes; 0 for two zeros."""
    scale = abs(a) + abs(b)
    return abs(a - b) / scale if scale else 0.0


def prod(values: Iterable[int]) -> int:
    return math.prod(values)


def median(values: Iterable[float]) -> float:
    """The middle value, or the mean of both middle ones."""
    v = sorted(values)
    if not v:
        raise ValueError("median of nothing")
    n = len(v)
    return v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def cast(text: str, kind: str) -> object:
    """Strict conversion of a whole string to string, int, double or bool, or to a 16-bit unsigned number."""
    if kind == "string":
        return text
    s = text.strip()
    try:
        if kind in ("int", "long", "uint16"):
            n = int(s)
            low, high = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1), "uint16": (0, 65535)}[kind]
            if "_" in s or not low <= n <= high:
                raise ValueError
            return n
        if kind in ("double", "float"):
            if "_" in s:
                raise ValueError
            return float(s)
        if kind == "bool":
            return {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}[s.lower()]
    except (ValueError, KeyError):
        raise ValueError(f"{text!r} is no {kind}") from None
    raise ValueError(f"unknown type {kind}")

"""Operators of grids. Importing this package registers every class for JSON."""

from . import analyzers, clippers, containers, dedispersion, detrenders, fillers, fused, masks  # noqa: F401
from .base import REGISTRY, Operator, from_json, register

__all__ = ["REGISTRY", "Operator", "from_json", "register"]

"""Sinks: packets, image tiles."""

from . import packets, tiles  # noqa: F401

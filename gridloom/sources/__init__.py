"""Sources: synthetic noise, file scans with gaps, tables, user functions, packed search files."""

from . import files, synthetic  # noqa: F401

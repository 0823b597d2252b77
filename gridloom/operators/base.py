"""The operator interface: bind checks, apply declares a plan; and the JSON registry."""

from __future__ import annotations

import dataclasses
import inspect
from collections.abc import Callable, Iterator
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from ..grid import Grid, GridMeta

REGISTRY: dict[str, Callable[[dict], Operator]] = {}


def register(class_name: str, factory: Callable[[dict], Operator]) -> None:
    """Make a class known to ``from_json``; a name can be taken only once."""
    if class_name in REGISTRY:
        raise ValueError(f"class_name {class_name!r} is registered already")
    REGISTRY[class_name] = factory


def field_names(op: Operator) -> list[str]:
    """The parameters of an operator that is a dataclass."""
    return [f.name for f in dataclasses.fields(op)] if dataclasses.is_dataclass(op) else []


class Operator:
    """Abstract operator. Subclasses are dataclasses; their fields are their JSON keys.

    ``bind`` checks parameters against the stream and returns what the next operator
    sees; ``apply`` maps the grid to a new one, lazily. ``in_sub_pipeline`` says whether
    the operator may run on a downsampled grid.
    """

    class_name: ClassVar[str] = ""
    in_sub_pipeline: ClassVar[bool] = False
    json_renames: ClassVar[dict[str, str]] = {}

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        if cls.__dict__.get("class_name"):
            register(cls.class_name, cls.from_json)

    def bind(self, meta: GridMeta) -> GridMeta:
        if meta.nds != 1 and not self.in_sub_pipeline:
            raise ValueError(f"{self.class_name or type(self).__name__} can't run on a downsampled grid (nds={meta.nds})")
        return self._bind(meta)

    def _bind(self, meta: GridMeta) -> GridMeta:
        return meta

    def apply(self, grid: Grid) -> Grid:
        raise NotImplementedError

    def __call__(self, grid: Grid) -> Grid:
        """Bind and apply."""
        meta = self.bind(grid.meta)
        out = self.apply(grid)
        return out if out.meta is not grid.meta else out.with_df(out.df, meta=meta)

    def children(self) -> list[Operator]:
        return []

    def jsonize(self) -> dict[str, Any]:
        if not self.class_name:
            raise TypeError(f"{type(self).__name__} has no JSON form")
        out: dict[str, Any] = {"class_name": self.class_name}
        for f in field_names(self):
            v = getattr(self, f)
            if f == "axis":
                v = f"AXIS_{v.upper()}"
            out[self.json_renames.get(f, f)] = [list(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, (list, tuple)) else v
        return out

    @classmethod
    def from_json(cls, j: dict[str, Any]) -> Operator:
        back = {v: k for k, v in cls.json_renames.items()}
        got = {back.get(k, k): v for k, v in j.items() if k != "class_name"}
        known = set(inspect.signature(cls).parameters)
        if extra := got.keys() - known:
            raise ValueError(f"{cls.class_name}: unknown keys {sorted(extra)}")
        return cls(**got)


class Source(Operator):
    """An operator without input: ``load`` makes the grid. ``has_chunks``: its packed chunks have a size already."""

    has_chunks: ClassVar[bool] = False

    def load(self, spark: Any) -> Grid:
        raise NotImplementedError

    def load_packed(self, spark: Any, nt_chunk: int) -> Any:
        """The grid in packed chunks; sources that can make them at once do without rows of cells."""
        from .fused import Packed

        return Packed.of(self.load(spark), nt_chunk)

    def apply(self, grid: Grid) -> Grid:
        raise TypeError("a source must come first")


class FunctionTransform(Operator):
    """A user's function of the cells: ``f(df, meta) -> df``. It has no JSON form."""

    in_sub_pipeline = True

    def __init__(self, f: Callable[[DataFrame, GridMeta], DataFrame], name: str = "transform") -> None:
        self.f, self.name = f, name

    def apply(self, grid: Grid) -> Grid:
        return grid.with_df(self.f(grid.df, grid.meta))


def from_json(j: Any) -> Operator:
    """An operator of its JSON form; a list is a pipeline of its elements."""
    if isinstance(j, list):
        j = {"class_name": "pipeline", "elements": j}
    if not isinstance(j, dict) or "class_name" not in j:
        raise ValueError("an operator is a JSON object with a class_name")
    if j["class_name"] not in REGISTRY:
        raise ValueError(f"unknown class_name {j['class_name']!r}")
    return REGISTRY[j["class_name"]](j)


def visit(op: Operator, depth: int = 0) -> Iterator[tuple[Operator, int]]:
    """(operator, depth), depth first."""
    yield op, depth
    for c in op.children():
        yield from visit(c, depth + 1)


def describe(op: Operator) -> str:
    """The operator tree as indented lines."""
    lines = []
    for o, d in visit(op):
        args = ", ".join(f"{k}={getattr(o, k)!r}" for k in field_names(o) if k not in ("elements", "sub_pipeline"))
        lines.append(f"{'  ' * d}{o.class_name or type(o).__name__}({args})")
    return "\n".join(lines)

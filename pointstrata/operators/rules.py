"""Rule classifiers: one boolean column per class, first match by priority wins.

A rule is a function of a ``Context`` of columns.  ``register`` adds one, also
from user code; ``classify`` turns the enabled rules into a single expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import colour


@dataclass(frozen=True)
class Context:
    """Columns a rule may use; ``rgb`` and ``intensity`` say whether they exist."""

    rgb: bool = True
    intensity: bool = True

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    def zone(self, letters: str) -> Column:
        return F.col("zone").isin(*letters)

    @property
    def ndvi(self) -> Column:
        return colour.ndvi(F.col("red"), F.col("green"))

    @property
    def brightness(self) -> Column:
        return colour.brightness(F.col("red"), F.col("green"), F.col("blue"))

    @property
    def saturation(self) -> Column:
        return colour.saturation(F.col("red"), F.col("green"), F.col("blue"))

    def if_rgb(self, cond: Callable[[], Column], missing: bool = True) -> Column:
        return cond() if self.rgb else F.lit(missing)

    def if_intensity(self, cond: Callable[[Column], Column]) -> Column:
        return cond(F.col("intensity")) if self.intensity else F.lit(True)


@dataclass
class Rule:
    class_id: int
    name: str
    priority: int
    test: Callable[[Context], Column]
    seq: int = field(default=0)


_registry: dict[int, Rule] = {}


def register(class_id: int, name: str, priority: int = 100):
    """Decorator: adds (or replaces) the rule of a class."""
    def add(fn: Callable[[Context], Column]):
        _registry[class_id] = Rule(class_id, name, priority, fn, len(_registry))
        return fn
    return add


def get(class_id: int) -> Rule | None:
    return _registry.get(class_id)


def get_all() -> dict[int, Rule]:
    return dict(_registry)


def clear() -> None:
    _registry.clear()


def ordered(enabled: Iterable[int] | None = None) -> list[Rule]:
    chosen = [r for r in _registry.values() if enabled is None or r.class_id in set(enabled)]
    return sorted(chosen, key=lambda r: (r.priority, r.seq))


def masks(ctx: Context = Context(), enabled: Iterable[int] | None = None) -> dict[int, Column]:
    return {r.class_id: r.test(ctx) for r in ordered(enabled)}


def classify(ctx: Context = Context(), enabled: Iterable[int] | None = None) -> Column:
    """Class of the first matching rule in priority order, else 1."""
    expr = None
    for r in ordered(enabled):
        if r.class_id == 1:
            continue
        cond = r.test(ctx)
        expr = F.when(cond, F.lit(r.class_id)) if expr is None else expr.when(cond, F.lit(r.class_id))
    return F.lit(1) if expr is None else expr.otherwise(F.lit(1))


def _add(class_id: int, name: str, priority: int, test: Callable[[Context], Column]) -> None:
    register(class_id, name, priority)(test)


def _never(_: Context) -> Column:
    return F.lit(False)


def load_defaults() -> None:
    """The 36 built-in rules; thresholds are fixed values."""
    clear()
    _add(2, "ground", 20, lambda c: c.zone("AB") & (c.planarity > 0.8) & (c.roughness < 0.15) & (c.horizontality > 0.9)
         & c.if_rgb(lambda: c.ndvi < 0.1))
    _add(3, "low vegetation", 50, lambda c: c.if_rgb(
        lambda: c.zone("B") & (c.ndvi > 0.1) & (c.roughness > 0.1) & (c.roughness < 0.4), False))
    _add(4, "medium vegetation", 50, lambda c: c.if_rgb(
        lambda: c.zone("BC") & (c.ndvi > 0.15) & (c.roughness > 0.2) & (c.height_variance > 0.5), False))
    _add(5, "high vegetation", 50, lambda c: c.if_rgb(
        lambda: c.zone("CD") & (c.ndvi > 0.15) & (c.roughness > 0.3) & (c.height_variance > 1.0), False))
    _add(6, "building", 10, lambda c: c.zone("BCD") & (c.planarity > 0.6) & (c.roughness < 0.2))
    _add(7, "noise", 99, lambda c: c.density < 5)
    _add(9, "water", 40, lambda c: c.zone("A") & (c.planarity > 0.85) & (c.roughness < 0.05)
         & c.if_intensity(lambda i: i < 0.2) & c.if_rgb(lambda: c.brightness < 0.3))
    _add(17, "bridge", 1, lambda c: c.zone("CD") & (c.planarity > 0.75) & (c.roughness < 0.12))
    _add(18, "rail", 15, lambda c: c.zone("BC") & (c.linearity > 0.7) & (c.horizontality > 0.85))
    _add(19, "power line", 30, lambda c: c.zone("D") & (c.linearity > 0.95))
    _add(20, "traction pole", 35, lambda c: c.zone("CD") & (c.linearity > 0.8) & (c.verticality > 0.85))
    _add(21, "platform", 25, lambda c: c.zone("BC") & (c.planarity > 0.8) & (c.horizontality > 0.9))
    _add(22, "railway sign", 45, lambda c: c.zone("BC") & (c.planarity > 0.6) & c.if_intensity(lambda i: i > 0.6))
    _add(23, "railway fence", 55, lambda c: c.zone("BC") & (c.linearity > 0.6) & (c.verticality > 0.7))
    _add(30, "road surface", 12, lambda c: c.zone("BC") & (c.planarity > 0.85) & (c.roughness < 0.08)
         & (c.horizontality > 0.95) & c.if_intensity(lambda i: i > 0.4) & c.if_rgb(lambda: c.saturation < 0.12))
    _add(31, "sidewalk", 28, lambda c: c.zone("B") & (c.planarity > 0.8) & (c.roughness < 0.12) & (c.horizontality > 0.9))
    _add(32, "curb", 22, lambda c: c.zone("B") & (c.linearity > 0.75))
    _add(33, "green strip", 52, lambda c: c.if_rgb(lambda: c.zone("B") & (c.roughness > 0.2) & (c.ndvi > 0.15), False))
    _add(34, "street light", 38, lambda c: c.zone("CD") & (c.linearity > 0.8) & (c.verticality > 0.85))
    _add(35, "road sign", 42, lambda c: c.zone("BC") & (c.planarity > 0.65) & c.if_intensity(lambda i: i > 0.7)
         & c.if_rgb(lambda: c.saturation > 0.3))
    _add(36, "road barrier", 48, lambda c: c.zone("BC") & (c.linearity > 0.65))
    _add(37, "bus stop", 58, lambda c: c.zone("B") & (c.planarity > 0.75))
    _add(38, "traffic light", 44, lambda c: c.zone("CD") & (c.linearity > 0.75) & (c.verticality > 0.8))
    _add(40, "external wall", 62, lambda c: (c.planarity > 0.7) & (c.verticality > 0.8))
    _add(41, "roof", 18, lambda c: c.zone("CD") & (c.planarity > 0.75))
    _add(42, "foundation", 65, lambda c: c.zone("AB") & (c.planarity > 0.7))
    _add(43, "column", 68, lambda c: (c.linearity > 0.85) & (c.verticality > 0.9) & (c.sphericity > 0.5))
    _add(44, "beam", 70, lambda c: (c.linearity > 0.8) & (c.horizontality > 0.8))
    _add(45, "pipe", 72, lambda c: (c.sphericity > 0.6) & (c.linearity > 0.7))
    _add(46, "window or door", 75, _never)
    _add(47, "railing", 78, lambda c: c.linearity > 0.6)
    _add(64, "telecom pole", 82, lambda c: c.zone("CD") & (c.linearity > 0.8) & (c.verticality > 0.85))
    _add(65, "sewage pipe", 85, lambda c: c.zone("A") & (c.sphericity > 0.7) & (c.linearity > 0.75))
    _add(66, "temporary element", 88, lambda c: (c.planarity < 0.5) & (c.height_variance > 0.5))
    _add(67, "construction detail", 92, _never)
    _add(1, "unclassified", 100, _never)


load_defaults()

"""Layers, their dependencies, and the order in which a request runs them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class UnknownLayerError(KeyError):
    """No layer provides what was asked for."""


class CycleError(ValueError):
    """Layers need each other in a circle."""


@dataclass(frozen=True)
class Layer:
    """One annotation step. ``after`` names layers it reads if they run, without asking for them."""

    name: str
    provides: frozenset[str]
    requires: frozenset[str]
    fn: Callable[[DataFrame, dict], DataFrame]
    after: frozenset[str] = field(default_factory=frozenset)


class Registry:
    """Layers by what they provide."""

    def __init__(self, layers: Iterable[Layer] = ()) -> None:
        self._by: dict[str, Layer] = {}
        for layer in layers:
            self.register(layer)

    def register(self, layer: Layer) -> None:
        """Add a layer; a second provider of the same thing is an error."""
        taken = layer.provides & self._by.keys()
        if taken:
            raise ValueError(f"already provided: {sorted(taken)}")
        self._by.update(dict.fromkeys(layer.provides, layer))

    def resolve(self, include: Iterable[str]) -> list[Layer]:
        """Layers for ``include``, prerequisites first, each once; the order is deterministic.

        Optional predecessors (``after``) only order layers that run anyway.
        """
        wanted: dict[str, Layer] = {}
        stack = sorted(include)
        while stack:
            need = stack.pop()
            if need not in self._by:
                raise UnknownLayerError(need)
            layer = self._by[need]
            if layer.name not in wanted:
                wanted[layer.name] = layer
                stack += sorted(layer.requires)
        edges = {n: {self._by[x].name for x in layer.requires | (layer.after & self._by.keys())} & wanted.keys() - {n} for n, layer in wanted.items()}
        for n, layer in wanted.items():
            if any(self._by[x].name == n for x in layer.requires):
                raise CycleError(n)
        order: list[Layer] = []
        while edges:
            ready = sorted(n for n, before in edges.items() if not before)
            if not ready:
                raise CycleError(", ".join(sorted(edges)))
            order.append(wanted[ready[0]])
            del edges[ready[0]]
            for before in edges.values():
                before.discard(ready[0])
        return order

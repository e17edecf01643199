"""A component as plain arrays, as the sequential algorithms take it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Small:
    """``names``: the node ids, ascending; nodes below are places in it. ``edges``: (u, v) in edge order, with their ids in
    ``ids`` and payloads in ``data`` (name -> list)."""

    names: list[int]
    edges: list[tuple[int, int]]
    ids: list[int]
    data: dict[str, list] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.names)

    def out(self) -> list[list[tuple[int, int]]]:
        """Per node (neighbour, edge place), in edge order."""
        a: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for k, (u, v) in enumerate(self.edges):
            a[u].append((v, k))
        return a

    def into(self) -> list[list[tuple[int, int]]]:
        a: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for k, (u, v) in enumerate(self.edges):
            a[v].append((u, k))
        return a

    def around(self) -> list[list[tuple[int, int]]]:
        """Incidences of an undirected graph in edge order; a loop is one incidence."""
        a: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for k, (u, v) in enumerate(self.edges):
            a[u].append((v, k))
            if u != v:
                a[v].append((u, k))
        return a

    def steps(self, direction: str) -> list[list[tuple[int, int]]]:
        """Outgoing, incoming, or both (outgoing first)."""
        if direction == "outgoing":
            return self.out()
        if direction == "incoming":
            return self.into()
        return [x + y for x, y in zip(self.out(), self.into(), strict=True)]

    def simple(self) -> list[list[int]]:
        """Undirected neighbours without repeats and loops, ascending."""
        s: list[set[int]] = [set() for _ in self.names]
        for u, v in self.edges:
            if u != v:
                s[u].add(v)
                s[v].add(u)
        return [sorted(x) for x in s]

    def simple_out(self) -> list[list[int]]:
        s: list[set[int]] = [set() for _ in self.names]
        for u, v in self.edges:
            s[u].add(v)
        return [sorted(x) for x in s]

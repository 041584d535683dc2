"""The first paths of maps, a map a group: a list is capped."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame

from trailweave.operators.roads import path_counts, reachable
from trailweave.operators.stages import gates
from trailweave.operators.walks import EXIT
from trailweave.operators.words import scenario_counts
from trailweave.sources.held import by_group
from trailweave.sources.tables import START

__all__ = ["first_paths", "gates", "path_counts", "reachable", "scenario_counts"]


_Exit = namedtuple("_Exit", EXIT)


class _Map:
    def __init__(self, rows: list[tuple]):
        self.ways: dict[str, list] = {}
        self.all = {}
        for r in sorted((_Exit(*r) for r in rows), key=lambda r: r.ord):
            self.all[r.edge_id] = r
            if r.edge_id != START:
                self.ways.setdefault(r.junction_id, []).append(r)

    def next(self, r) -> list:
        """The exits that may follow r; over a retry, the loop's exit alone."""
        if r.to_kind == "retry":
            junction = self.all[r.to_id].junction_id
            return [e for e in self.ways[junction] if e.label == "exit"]
        if r.to_kind != "junction":
            return []
        return [e for e in self.ways.get(r.to_id, []) if not e.is_retry and (r.only_edge is None or e.edge_id == r.only_edge)]


def _alive(m: _Map) -> dict[str, bool]:
    """Of each exit whether an end can be reached by it: a search from the ends backwards, which bears ways that lead back."""
    before: dict[str, list[str]] = {}
    for edge, r in m.all.items():
        for e in m.next(r):
            before.setdefault(e.edge_id, []).append(edge)
        if r.to_kind == "retry":
            before.setdefault(r.to_id, []).append(edge)
    alive, todo = dict.fromkeys(m.all, False), [edge for edge, r in m.all.items() if r.to_kind == "end"]
    while todo:
        edge = todo.pop()
        if not alive[edge]:
            alive[edge] = True
            todo += before.get(edge, [])
    return alive


def first_paths(exits: DataFrame, cap: int) -> DataFrame:
    """workflow, number, steps, end, truncated: each map's first cap paths in the order of exits; truncated if there are more.

    A path takes an exit once at most. Exits that lead to no end are not entered, so each step made belongs to a path
    unless its way is blocked by exits that it has taken already.
    """

    def walk(rows: list[tuple]) -> Iterator[tuple]:
        m = _Map(rows)
        alive, found = _alive(m), []

        def after(r) -> list:
            to = [m.all[r.to_id]] if r.to_kind == "retry" else m.next(r)
            return [e for e in to if alive[e.edge_id]]

        steps: list[str] = []
        taken, stack = set(), [iter(after(m.all[START]))]
        if m.all[START].to_kind == "end":
            found.append(([], m.all[START].to_id))
        while stack and len(found) <= cap:
            e = next(stack[-1], None)
            if e is None:
                stack.pop()
                if steps:
                    taken.remove(steps.pop())
            elif e.edge_id not in taken:
                steps.append(e.edge_id)
                taken.add(e.edge_id)
                if e.to_kind == "end":
                    found.append((list(steps), e.to_id))
                stack.append(iter(after(e) if e.to_kind != "end" else []))
        for number, (path, end) in enumerate(found[:cap]):
            yield number + 1, path, end, len(found) > cap

    return by_group(exits.select("workflow", *EXIT), ["workflow"], walk, "number int, steps array<string>, end string, truncated boolean")

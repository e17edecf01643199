"""Depth-first walks, cycles, dominators and orderings of one component."""

from __future__ import annotations

import heapq
from collections import deque

from lodestone.kernels.small import Small


def dfs(g: Small, start: int, direction: str = "outgoing", limit: int | None = None) -> list[int]:
    """Order of a stack whose nodes are marked when they are pushed; neighbours are pushed so that the first comes off first."""
    adj = g.steps(direction)
    seen, stack, order = {start}, [start], []
    while stack and (limit is None or len(order) < limit):
        u = stack.pop()
        order.append(u)
        fresh = []
        for v, _ in adj[u]:
            if v not in seen:
                seen.add(v)
                fresh.append(v)
        stack += reversed(fresh)
    return order


def dfs_events(g: Small, roots: list[int], direction: str = "outgoing") -> list[tuple]:
    """(event, node or source, target, edge): discover, tree_edge, back_edge, cross_forward_edge, finish."""
    adj = g.steps(direction)
    colour, out = [0] * g.n, []
    for root in roots:
        if colour[root]:
            continue
        colour[root] = 1
        out.append(("discover", root, None, None))
        stack = [(root, iter(adj[root]))]
        while stack:
            u, rest = stack[-1]
            for v, k in rest:
                if colour[v] == 0:
                    out.append(("tree_edge", u, v, g.ids[k]))
                    colour[v] = 1
                    out.append(("discover", v, None, None))
                    stack.append((v, iter(adj[v])))
                    break
                out.append(("back_edge" if colour[v] == 1 else "cross_forward_edge", u, v, g.ids[k]))
            else:
                colour[u] = 2
                out.append(("finish", u, None, None))
                stack.pop()
    return out


def find_cycle(g: Small) -> list[int] | None:
    """Closed path of the first back edge that a depth-first search from the nodes in order meets."""
    adj, colour = g.out(), [0] * g.n
    for root in range(g.n):
        if colour[root]:
            continue
        colour[root], path, stack = 1, [root], [iter(adj[root])]
        while stack:
            for v, _ in stack[-1]:
                if colour[v] == 1:
                    return [*path[path.index(v) :], v]
                if colour[v] == 0:
                    colour[v] = 1
                    path.append(v)
                    stack.append(iter(adj[v]))
                    break
            else:
                colour[path.pop()] = 2
                stack.pop()
    return None


def immediate_dominators(g: Small, root: int) -> dict[int, int | None]:
    """Of every node that ``root`` reaches; None for the root. Fixpoint over reverse postorder."""
    adj = g.out()
    seen, post, stack = {root}, [], [(root, iter(adj[root]))]
    while stack:
        u, rest = stack[-1]
        for v, _ in rest:
            if v not in seen:
                seen.add(v)
                stack.append((v, iter(adj[v])))
                break
        else:
            post.append(u)
            stack.pop()
    rank = {u: k for k, u in enumerate(post)}
    back = g.into()
    idom: dict[int, int] = {root: root}
    moved = True
    while moved:
        moved = False
        for u in reversed(post[:-1]):
            best = None
            for p, _ in back[u]:
                if p not in idom:
                    continue
                a, b = p, best
                if b is None:
                    best = a
                    continue
                while a != b:
                    if rank[a] < rank[b]:
                        a = idom[a]
                    else:
                        b = idom[b]
                best = a
            if best is not None and idom.get(u) != best:
                idom[u] = best
                moved = True
    return {u: None if u == root else idom[u] for u in seen}


def dominance_frontiers(g: Small, root: int) -> dict[int, list[int]]:
    idom = immediate_dominators(g, root)
    front: dict[int, set[int]] = {u: set() for u in idom}
    back = g.into()
    for u in idom:
        before = {p for p, _ in back[u] if p in idom}
        if len(before) < 2:
            continue
        for p in before:
            while p is not None and p != idom[u]:
                front[p].add(u)
                p = idom[p]
    return {u: sorted(v) for u, v in front.items()}


def feedback_order(g: Small) -> list[int]:
    """Sinks to the right, sources to the left, else the node of greatest surplus of outgoing edges (smallest node of those)."""
    adj, back = g.out(), g.into()
    outs, ins = [len(x) for x in adj], [len(x) for x in back]
    live, left, right = set(range(g.n)), [], deque()
    sinks, sources = [u for u in live if outs[u] == 0], [u for u in live if ins[u] == 0]
    surplus = [(ins[u] - outs[u], u) for u in live]
    heapq.heapify(surplus)

    def take(u: int) -> None:
        live.discard(u)
        for degree, empty, near in ((ins, sources, adj[u]), (outs, sinks, back[u])):
            for v, _ in near:
                if v in live:
                    degree[v] -= 1
                    if degree[v] == 0:
                        empty.append(v)
                    heapq.heappush(surplus, (ins[v] - outs[v], v))

    while live:
        if sinks:
            u = sinks.pop()
            if u in live:
                right.appendleft(u)
                take(u)
        elif sources:
            u = sources.pop()
            if u in live:
                left.append(u)
                take(u)
        else:
            x, u = heapq.heappop(surplus)
            if u in live and x == ins[u] - outs[u]:
                left.append(u)
                take(u)
    return left + list(right)


def feedback_arcs(g: Small) -> list[int]:
    """Edges against the order: loops always, and a set whose removal leaves no cycle."""
    place = {u: k for k, u in enumerate(feedback_order(g))}
    return [g.ids[k] for k, (u, v) in enumerate(g.edges) if place[u] >= place[v]]


def label_propagation(g: Small, rounds: int) -> list[int]:
    """Labels changed one node at a time, in order, to the commonest among the neighbours (smallest of those)."""
    near, label = g.simple(), list(range(g.n))
    for _ in range(rounds):
        moved = False
        for u in range(g.n):
            if not near[u]:
                continue
            count: dict[int, int] = {}
            for v in near[u]:
                count[label[v]] = count.get(label[v], 0) + 1
            best = min(count, key=lambda x: (-count[x], x))
            if best != label[u]:
                label[u], moved = best, True
        if not moved:
            break
    return label

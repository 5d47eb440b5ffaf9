"""Byte automata: rules compiled by subset construction and minimisation into transition arrays."""

from __future__ import annotations

import functools
from re import _constants as C
from re import _parser

import numpy as np


class Nfa:
    """Thompson automaton; ``edges[s]`` holds (byte set, target), ``free[s]`` the empty moves."""

    def __init__(self, backward: bool = False) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.backward = backward

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, items, at: int) -> int:
        """Appends parsed regex items after state ``at``, last item first if ``backward``; returns the end state."""
        for op, arg in reversed(list(items)) if self.backward else items:
            if op is C.LITERAL:
                at = self._step(at, frozenset([arg]))
            elif op is C.IN:
                at = self._step(at, _byte_set(arg))
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at)
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.add(branch, at)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                at = self._repeat(at, *arg)
            else:
                raise ValueError(f"rule uses an unsupported construct: {op}")
        return at

    def _step(self, at: int, chars: frozenset) -> int:
        end = self.state()
        self.edges[at].append((chars, end))
        return end

    def _repeat(self, at: int, least: int, most, items) -> int:
        for _ in range(least):
            at = self.add(items, at)
        if most is C.MAXREPEAT:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(items, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.free[at].append(end)
            at = self.add(items, at)
        self.free[at].append(end)
        return end


def _byte_set(items) -> frozenset:
    out: set[int] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"rule uses an unsupported class item: {op}")
    return frozenset(out)


class Dfa:
    """Combined automaton of several rules: one that finds them anywhere, or a backward one that reads from a place
    where a rule ends towards its start and nothing else.

    ``table`` (states x classes, flat), ``classes`` (byte -> class), ``accept`` (state -> bits of the rules that
    end here), ``first_accept`` (accepting states have the highest numbers), ``reset`` (byte -> True where the
    byte leads every state to the start, so that a scan may begin anew after it).
    """

    def __init__(self, patterns: list[bytes], backward: bool = False) -> None:
        nfa = Nfa(backward)
        start = nfa.state()
        ends = [nfa.add(_parser.parse(p), start) for p in patterns]
        self.classes, sample = _byte_classes(nfa)
        table, accept = _subsets(nfa, start, ends, sample, anywhere=not backward)
        table, accept = _minimise(table, accept)
        order = np.argsort(accept > 0, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        table, self.accept = rank[table[order]], accept[order]
        self.first_accept = int((self.accept == 0).sum())
        self.start = int(rank[0])
        self.n_classes = table.shape[1]
        self.reset = (table == self.start).all(axis=0)[self.classes]
        self.table = np.ascontiguousarray(table.astype(np.int32) * self.n_classes).ravel()  # targets as row offsets

    def scan(self, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(positions of bytes, rule bits): where rules end, ascending, in one pass over the bytes of ``data``.

        The bytes are cut after reset bytes into many lanes, which all step together; few remaining long
        lanes are finished byte by byte.
        """
        n, nc = len(data), self.n_classes
        none = np.zeros(0, np.int64)
        if not n:
            return none, none
        resets = np.flatnonzero(self.reset[data])
        want = np.arange(1, min(lanes, n // 64) + 1, dtype=np.int64) * n // (min(lanes, n // 64) + 1)
        at = np.searchsorted(resets, want)
        cuts = np.unique(np.concatenate([[0], resets[at[at < len(resets)]] + 1]))
        cuts = cuts[cuts < n]
        sizes = np.diff(np.append(cuts, n))
        order = np.argsort(-sizes, kind="stable")
        pos, sizes = cuts[order], sizes[order]
        cls, table, limit = self.classes[data], self.table, self.first_accept * nc
        state = np.full(len(pos), self.start * nc, np.int32)
        places, states = [], []
        alive, step = len(pos), 0
        shrink = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right") if len(sizes) else []
        for step in range(int(sizes[0])):
            alive = int(shrink[step])
            if alive <= 8:
                break
            pos, state = pos[:alive], state[:alive]
            state = table[state + cls[pos + step]]
            hit = np.flatnonzero(state >= limit)
            if len(hit):
                places.append(pos[hit] + step)
                states.append(state[hit])
        else:
            step += 1
        if alive <= 8 and step < int(sizes[0]):
            flat, found = table.tolist(), []
            for k in range(alive):
                s, p = int(state[k]), int(pos[k]) + step
                for c in cls[p : int(pos[k]) + int(sizes[k])].tolist():
                    s = flat[s + c]
                    if s >= limit:
                        found.append((p, s))
                    p += 1
            if found:
                where, there = np.array(found, np.int64).T
                places.append(where)
                states.append(there)
        if not places:
            return none, none
        places, states = np.concatenate(places), np.concatenate(states)
        order = np.argsort(places, kind="stable")
        return places[order], self.accept[states[order] // nc]

    def longest(self, data: bytes, last: int, bit: int) -> int:
        """Of a backward automaton: the first byte of the longest match of rule ``bit`` that ends with byte ``last``."""
        table, classes, accept, nc = self._lists
        state, at, first = self.start, last, last + 1
        while at >= 0:
            state = table[state * nc + classes[data[at]]] // nc
            if state == self._dead:
                break
            if accept[state] >> bit & 1:
                first = at
            at -= 1
        return first

    @functools.cached_property
    def _lists(self) -> tuple[list, list, list, int]:
        return self.table.tolist(), self.classes.tolist(), self.accept.tolist(), self.n_classes

    @functools.cached_property
    def _dead(self) -> int:
        """The state that nothing leaves and where no rule ends, or -1."""
        rows = self.table.reshape(-1, self.n_classes) // self.n_classes
        dead = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(axis=1) & (self.accept == 0))
        return int(dead[0]) if len(dead) else -1


def _byte_classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that no edge tells apart share a class."""
    signature: dict[tuple, int] = {}
    sets = list({chars for edges in nfa.edges for chars, _ in edges})
    classes, sample = np.zeros(256, np.int32), []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in signature:
            signature[key] = len(sample)
            sample.append(b)
        classes[b] = signature[key]
    return classes, sample


def _subsets(nfa: Nfa, start: int, ends: list[int], sample: list[int], anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction; with ``anywhere`` the start set stays in every subset, as a match may begin at any byte."""

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    moves = [[[] for _ in sample] for _ in nfa.edges]
    for s, edges in enumerate(nfa.edges):
        for chars, t in edges:
            closed = closure([t])
            for k, b in enumerate(sample):
                if b in chars:
                    moves[s][k].append(closed)
    first = closure([start])
    number, todo, rows = {first: 0}, [first], []
    for subset in todo:
        live = [moves[s] for s in subset if nfa.edges[s]]
        row = []
        for k in range(len(sample)):
            to = (first if anywhere else frozenset()).union(*(c for m in live for c in m[k]))
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    accept = np.array([sum(1 << r for r, e in enumerate(ends) if e in s) for s in todo], np.int64)
    return np.array(rows, np.int32), accept


def _minimise(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: states stay together while their accept bits and successors' blocks agree."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)  # the start state keeps number 0
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[block[table[first[order]]]], accept[first[order]]

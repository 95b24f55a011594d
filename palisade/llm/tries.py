"""Distinct strings as one trie in arrays, and the pieces of a vocabulary that end at its nodes.

Strings are sorted, so what a string shares with the ones before it is its longest common
prefix with its predecessor; every further character is a node of its own. Nodes are numbered level
by level from 1, and 0 is the root, so a forward computation goes through the levels and does
all nodes of a level at once.

Pieces are found by walking the vocabulary's own trie from every place, again all places at
once: a step looks the pair of state and character up among the vocabulary's edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np

CHARACTERS = 1 << 20  # of strings that share a trie, about a hundred bytes each
KEPT = 2 << 20        # of strings whose results are kept


def parts(strings: list[str]) -> Iterator[list[str]]:
    """Sorted strings in lists that make tries of bounded size.

    A trie has ``CHARACTERS`` characters besides its last string; a string between two tries
    does not share its prefixes with the next one.
    """
    own, size = [], 0
    for string in strings:
        own.append(string)
        size += len(string)
        if size >= CHARACTERS:
            yield own
            own, size = [], 0
    if own:
        yield own


class Solved:
    """What ``solve`` gives for strings, solved in tries of distinct ones and kept for later batches.

    ``solve`` takes distinct, sorted strings. Results of the latest strings are kept, some
    ``kept`` (``KEPT`` where it is not given) to twice as many characters of them.
    """

    def __init__(self, solve: Callable[[list[str]], Iterable], kept: int | None = None) -> None:
        self.solve, self.kept = solve, kept
        self.recent: dict = {}
        self.older: dict = {}
        self.size = 0

    def __call__(self, groups: Iterable[list[str]]) -> dict:
        """The results of all strings in ``groups``."""
        wanted = set(chain.from_iterable(groups))
        made = {s: self.recent[s] for s in wanted if s in self.recent}
        fresh = {s: self.older[s] for s in wanted if s in self.older and s not in made}
        for part in parts(sorted(wanted - made.keys() - fresh.keys())):
            fresh.update(zip(part, self.solve(part)))
        kept = KEPT if self.kept is None else self.kept
        added = sum(map(len, fresh))
        if self.size + added > kept:
            self.older, self.recent, self.size = self.recent, {}, 0
        if added <= kept:
            self.recent.update(fresh)
            self.size += added
        return made | fresh


class Vocabulary:
    """The pieces as a trie: sorted edges (state, character) and the piece that ends in a state."""

    def __init__(self, pieces: list[str]) -> None:
        states: dict[str, int] = {"": 0}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        self.longest = max(map(len, pieces), default=0)
        letters = sorted({c for p in pieces for c in p})
        # Characters outside the vocabulary have the code 0.
        self.codes = np.zeros(0x110000, np.int64)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        edges = sorted((states[p[:-1]] * self.width + int(self.codes[ord(p[-1])]), s) for p, s in states.items() if p)
        self.edges = np.array([k for k, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.children = np.array([s for _, s in edges] + [0], np.int64)
        # The first step needs no search.
        self.first = np.zeros(self.width, np.int64)
        for c in letters:
            self.first[self.codes[ord(c)]] = states.get(c, 0)
        self.piece = np.full(len(states), -1, np.int64)
        self.piece[[states[p] for p in pieces]] = np.arange(len(pieces))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each state along each character, 0 where there is none."""
        key = state * self.width + code
        at = np.searchsorted(self.edges, key)
        return np.where(self.edges[at] == key, self.children[at], 0)


class Matches(NamedTuple):
    """Pieces that end at nodes, ordered by node, longest first."""

    node: np.ndarray
    before: np.ndarray  # the node where the piece starts: 0 for the root
    piece: np.ndarray
    length: np.ndarray


class Trie:
    """``strings`` are distinct, sorted and not empty."""

    def __init__(self, strings: list[str]) -> None:
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(strings)), self.sizes)
        self.depth = np.arange(len(self.points)) - self.begins[owner] + 1
        # Equal to the character at the same depth of the string before.
        before = np.maximum(owner - 1, 0)
        there = (owner > 0) & (self.depth <= self.sizes[before])
        at = np.flatnonzero(there)
        differs = np.ones(len(self.points), bool)
        differs[at] = self.points[at] != self.points[self.begins[before[at]] + self.depth[at] - 1]
        so_far = np.cumsum(differs)
        self.new = so_far - (so_far[self.begins] - differs[self.begins])[owner] > 0
        # Level by level; a place that is not new stands for the last new one of its depth.
        order = np.argsort(self.depth, kind="stable")
        self.node = np.empty(len(self.points), np.int64)
        self.node[order] = np.cumsum(self.new[order])
        self.levels = np.concatenate([[1], 1 + np.cumsum(np.bincount(self.depth[self.new])[1:])]) if len(strings) else np.ones(1, np.int64)
        self.nodes = int(self.levels[-1])  # with the root
        self.last = self.node[self.ends - 1]
        self.string_end = self.ends[owner]
        # One place for each node.
        self.place = np.zeros(self.nodes, np.int64)
        self.place[self.node[self.new]] = np.flatnonzero(self.new)

    def matches(self, vocabulary: Vocabulary) -> Matches:
        code = vocabulary.codes[self.points]
        at = np.arange(len(code))
        state = vocabulary.first[code]
        found = []
        for length in range(1, vocabulary.longest + 1):
            if length > 1:
                going = (state > 0) & (at + length <= self.string_end[at])
                at, state = at[going], state[going]
                state = vocabulary.step(state, code[at + length - 1])
            piece = vocabulary.piece[state]
            hit = (piece >= 0) & self.new[at + length - 1]
            end = at[hit] + length - 1
            before = np.where(self.depth[end] == length, 0, self.node[end - length])
            found.append((self.node[end], before, piece[hit], np.full(len(end), length)))
        node, before, piece, length = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(node * (vocabulary.longest + 1) + (vocabulary.longest - length))
        return Matches(node[order], before[order], piece[order], length[order])

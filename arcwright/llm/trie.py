"""A compressed radix (Patricia) trie over byte strings that owns the smallest id of each string."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import xxhash

#: Bytes a node costs besides its label: two lists' worth of object headers and one dict slot.
NODE_COST = 320


#: Parts that an oversized spill file is dealt into hold half the budget each, on average.
HALF = 2
#: Open files of one dealing.
MOST_PARTS = 256


class _Node:
    """An edge label and what hangs below it. ``spill`` is the file of a subtree moved to disk."""

    __slots__ = ("label", "children", "entry", "spill", "cost")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] | None = None
        self.entry: list | None = None
        self.spill: _Spill | None = None
        self.cost = 0


class _Spill:
    """Keys with their entries in a private temporary file of this task, unlinked at once."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  gone with the task
        self.bytes = 0

    def add(self, key: bytes, ident, count: int, payload) -> None:
        pickle.dump((key, ident, count, payload), self.file, protocol=5)
        self.bytes += len(key) + NODE_COST

    def read(self) -> Iterator[tuple]:
        self.file.seek(0)
        with self.file:
            while True:
                try:
                    yield pickle.load(self.file)
                except EOFError:
                    return


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slice comparisons."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaOwners:
    """Insert ``(key, id, count, payload)``; read back one owner per distinct key.

    A terminal node keeps the smallest id, the summed count and the payload that came first.
    Beyond ``budget`` bytes the costliest subtree below the root goes to a private temporary
    file of this task, and later keys of that subtree are appended to it. When the owners are
    read, each such file becomes a trie of its own; one above the budget is first dealt by a hash
    of the key into parts that are expected to fit. So a key is written twice at most, whatever
    prefix the keys share. A lost executor loses the files with the task, and the retried task
    makes them anew.
    """

    def __init__(self, budget: int = 64 << 20):
        self.budget = budget
        self.root: dict[int, _Node] = {}
        self.empty: list | None = None
        self.used = 0
        self.spilled = 0

    def insert(self, key: bytes, ident: int | None, count: int, payload) -> None:
        if not key:
            self.empty = _merge(self.empty, ident, count, payload)
            return
        first = key[0]
        top = self.root.get(first)
        if top is None:
            top = self.root[first] = _Node(key)
            top.entry = [ident, count, payload]
            self._grew(first, len(top.label) + NODE_COST)
            return
        if top.spill is not None:
            top.spill.add(key, ident, count, payload)
            return
        self._grew(first, self._descend(first, key, ident, count, payload))

    def _descend(self, first: int, key: bytes, ident, count, payload) -> int:
        """Place the key below the root's child ``first``; the bytes that this took."""
        holder: dict[int, _Node] = self.root
        at = 0
        while True:
            node = holder[first]
            label = node.label
            if key.startswith(label, at):
                at += len(label)
                if at == len(key):
                    node.entry = _merge(node.entry, ident, count, payload)
                    return 0
                first = key[at]
                if node.children is None:
                    node.children = {}
                if first not in node.children:
                    leaf = node.children[first] = _Node(key[at:])
                    leaf.entry = [ident, count, payload]
                    return len(leaf.label) + NODE_COST
                holder = node.children
                continue
            # The key leaves inside the label: the label splits there.
            cut = _shared(label, key[at : at + len(label)])
            upper = _Node(label[:cut])
            upper.cost = node.cost
            node.label = label[cut:]
            upper.children = {node.label[0]: node}
            holder[first] = upper
            at += cut
            if at == len(key):
                upper.entry = [ident, count, payload]
                return NODE_COST
            leaf = upper.children[key[at]] = _Node(key[at:])
            leaf.entry = [ident, count, payload]
            return len(leaf.label) + 2 * NODE_COST

    def _grew(self, first: int, by: int) -> None:
        if not by:
            return
        self.root[first].cost += by
        self.used += by
        while self.used > self.budget:
            worst = max((n for n in self.root.values() if n.spill is None), key=lambda n: n.cost)
            self._spill(worst)

    def _spill(self, node: _Node) -> None:
        out = _Spill()
        for key, entry in _walk(node):
            out.add(key, *entry)
        self.used -= node.cost
        self.spilled += 1
        node.children, node.entry, node.cost, node.spill = None, None, 0, out
        node.label = node.label[:1]

    def owners(self) -> Iterator[tuple[int | None, int, object]]:
        """``(smallest id, count, payload)`` of each distinct key."""
        if self.empty is not None:
            yield tuple(self.empty)
        files = []
        for node in self.root.values():
            if node.spill is not None:
                files.append(node.spill)
                continue
            for _, entry in _walk(node):
                yield tuple(entry)
        self.root = {}
        for file in files:
            for part in self._parts(file):
                below = PatriciaOwners(budget=1 << 62)
                for key, ident, count, payload in part.read():
                    below.insert(key, ident, count, payload)
                yield from below.owners()

    def _parts(self, file: _Spill) -> list[_Spill]:
        """The file, or its keys dealt by hash to as many files as the budget asks for."""
        n = -(-file.bytes * HALF // self.budget)
        if n <= HALF:
            return [file]
        parts = [_Spill() for _ in range(min(n, MOST_PARTS))]
        for key, ident, count, payload in file.read():
            parts[xxhash.xxh64_intdigest(key, 11) % len(parts)].add(key, ident, count, payload)
        return parts


def _merge(entry: list | None, ident, count: int, payload) -> list:
    if entry is None:
        return [ident, count, payload]
    if entry[0] is None or (ident is not None and ident < entry[0]):
        entry[0] = ident
    entry[1] += count
    return entry


def _walk(node: _Node) -> Iterator[tuple[bytes, list]]:
    """Every key below a node, from its own label on, with its entry."""
    stack = [(node, node.label)]
    while stack:
        node, path = stack.pop()
        if node.entry is not None:
            yield path, node.entry
        if node.children:
            stack.extend((child, path + child.label) for child in node.children.values())

"""An adaptive radix tree over byte paths, with members at the ends of the paths.

Inner nodes hold their children in one of four layouts that grow with them: up to 4 and up
to 16 sorted keys, up to 48 children behind an index of 256 bytes, and 256 direct places.
Bytes without a branch are compressed into the edge that leads to a node. A path may end
where another goes on, so every node can hold members.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class SortedKeys:
    """Children of up to ``room`` bytes, sorted."""

    __slots__ = ("room", "keys", "nodes")

    def __init__(self, room: int) -> None:
        self.room, self.keys, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        i = bisect_left(self.keys, byte)
        return self.nodes[i] if i < len(self.keys) and self.keys[i] == byte else None

    def put(self, byte: int, node: Node) -> bool:
        """False if there is no room for one more byte."""
        i = bisect_left(self.keys, byte)
        if i < len(self.keys) and self.keys[i] == byte:
            self.nodes[i] = node
            return True
        if len(self.keys) == self.room:
            return False
        self.keys.insert(i, byte)
        self.nodes.insert(i, node)
        return True

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.nodes, strict=True)


class IndexedKeys:
    """Up to 48 children; a byte's place is found in an index, 0 for none."""

    __slots__ = ("index", "nodes")

    def __init__(self) -> None:
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        place = self.index[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node) -> bool:
        place = self.index[byte]
        if place:
            self.nodes[place - 1] = node
            return True
        if len(self.nodes) == 48:
            return False
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return True

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[place - 1]) for byte, place in enumerate(self.index) if place)


class DirectKeys:
    """A place for every byte."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


def _larger(layout: SortedKeys | IndexedKeys) -> SortedKeys | IndexedKeys | DirectKeys:
    if isinstance(layout, IndexedKeys):
        grown: SortedKeys | IndexedKeys | DirectKeys = DirectKeys()
    else:
        grown = SortedKeys(16) if layout.room == 4 else IndexedKeys()
    for byte, node in layout.items():
        grown.put(byte, node)
    return grown


class Node:
    """``edge`` are the bytes from the parent to here; ``members`` end here, ``note`` is theirs."""

    __slots__ = ("edge", "children", "members", "note", "sums")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.children, self.members, self.note, self.sums = edge, None, [], None, None

    def child(self, byte: int) -> Node | None:
        return self.children.get(byte) if self.children is not None else None

    def attach(self, node: Node) -> None:
        if self.children is None:
            self.children = SortedKeys(4)
        if not self.children.put(node.edge[0], node):
            self.children = _larger(self.children)
            self.children.put(node.edge[0], node)

    def branches(self) -> Iterator[Node]:
        """The children in the order of their bytes."""
        return iter(()) if self.children is None else (node for _, node in self.children.items())


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common beginning of ``a`` and ``b[start:]``."""
    if b.startswith(a, start):
        return len(a)
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[start:start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, path: bytes, member: int, note: object) -> Node:
        """Add a member whose path ends here; ``note`` is the same for equal paths."""
        node, at = self.root, 0
        while at < len(path):
            below = node.child(path[at])
            if below is None:
                below = Node(path[at:])
                node.attach(below)
                node = below
                break
            same = _common(below.edge, path, at)
            if same < len(below.edge):
                split = Node(below.edge[:same])
                below.edge = below.edge[same:]
                split.attach(below)
                node.attach(split)
                below = split
            node, at = below, at + same
        node.members.append(member)
        node.note = note
        return node

    def walk(self, path: bytes) -> Iterator[Node]:
        """The nodes on the way to the end of an inserted path, the root first."""
        node, at = self.root, 0
        yield node
        while at < len(path):
            node = node.child(path[at])
            at += len(node.edge)
            yield node

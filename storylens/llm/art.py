"""Adaptive radix tree over byte strings: compressed paths, and inner nodes in
one of four layouts that grow with their number of children."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

# Children that a node of each layout holds at most.
LAYOUTS = (4, 16, 48, 256)


class Node:
    """``path``: the bytes from the parent to this node, the branching byte
    first. ``value``: what is stored under the string that ends here. ``some``:
    the value of any string that passes here. Layouts 4 and 16 keep sorted
    bytes beside their children, 48 an index of 256 bytes, 256 a slot a byte."""

    __slots__ = ("path", "value", "some", "layout", "keys", "kids")

    def __init__(self, path: bytes, value: int | None, some: int):
        self.path, self.value, self.some = path, value, some
        self.layout, self.keys, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.kids[byte]
        if self.layout == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, kid: Node) -> None:
        """Add a child, or replace the one of that byte."""
        if self.layout == 256:
            self.kids[byte] = kid
            return
        if self.layout == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = kid
                return
            if len(self.kids) < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
                return
        else:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = kid
                return
            if len(self.kids) < self.layout:
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
                return
        self.grow()
        self.put(byte, kid)

    def grow(self) -> None:
        """Take the next layout."""
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.layout, self.keys = 48, index
        else:
            self.kids = [self.kids[at - 1] if at else None for at in self.keys]
            self.layout, self.keys = 256, bytearray()

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.layout == 256:
            return [k for k in self.kids if k is not None]
        if self.layout == 48:
            return [self.kids[at - 1] for at in self.keys if at]
        return list(self.kids)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def insert(root: Node, key: bytes, value: int) -> None:
    """Store a value under a string that is not in the tree yet."""
    node, at = root, 0
    while True:
        if at == len(key):
            node.value = value
            return
        kid = node.child(key[at])
        if kid is None:
            node.put(key[at], Node(key[at:], value, value))
            return
        same = common(kid.path, key[at:at + len(kid.path)])
        if same < len(kid.path):  # the compressed path is split
            middle = Node(kid.path[:same], None, kid.some)
            kid.path = kid.path[same:]
            middle.put(kid.path[0], kid)
            node.put(key[at], middle)
            kid = middle
        node, at = kid, at + same


def built(keys: list[bytes]) -> Node:
    """The tree of distinct strings, each with its index as value."""
    root = Node(b"", None, 0)
    for i, key in enumerate(keys):
        insert(root, key, i)
    return root


def aligned(root: Node, width: int) -> Iterator[tuple[int, int, int, int | None]]:
    """``depth, parent, some, value`` of each place at a multiple of ``width``
    bytes, in pre-order, children by their bytes. ``parent`` is the index of the
    place above (-1: none). Places between are passed over."""
    made = 0
    stack = [(root, 0, -1)]
    while stack:
        node, start, parent = stack.pop()
        end = start + len(node.path)
        first = 0 if node is root else start // width + 1
        for depth in range(first, end // width + 1):
            yield depth, parent, node.some, node.value if depth * width == end else None
            parent, made = made, made + 1
        stack += [(kid, end, parent) for kid in reversed(node.children())]

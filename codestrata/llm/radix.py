"""Adaptive radix tree over byte keys, after Leis, Kemper and Neumann (ICDE 2013): four node layouts and path compression.

A node holds the bytes of its path that don't branch (``prefix``) and the row whose key ends at it (``row``, -1 if none).
Layouts grow with the number of children: sorted bytes and children up to 4 and up to 16, an index of 256 bytes into up to
48 children, and a plain table of 256 children.  A leaf is a node without children that keeps the whole rest of its key.
"""

from __future__ import annotations

from bisect import bisect_left


class Leaf:
    """A key's end without children; its prefix is the whole rest of the key."""

    __slots__ = ("prefix", "row")
    limit = 0

    def __init__(self, prefix: bytes = b"", row: int = -1):
        self.prefix, self.row = prefix, row

    def find(self, byte: int):
        return None

    def children(self):
        return ()

    def grown(self):
        return Node4(self.prefix, self.row)

    def full(self) -> bool:
        return True


class Sorted:
    """Up to ``limit`` children beside their sorted bytes."""

    __slots__ = ("prefix", "row", "bytes", "kids")
    limit = 0

    def __init__(self, prefix: bytes = b"", row: int = -1):
        self.prefix, self.row, self.bytes, self.kids = prefix, row, bytearray(), []

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def full(self) -> bool:
        return len(self.kids) == self.limit

    def put(self, byte: int, child) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = child
        else:
            self.bytes.insert(at, byte)
            self.kids.insert(at, child)

    def children(self):
        return self.kids

    def grown(self):
        node = self.larger(self.prefix, self.row)
        for byte, child in zip(self.bytes, self.kids):
            node.put(byte, child)
        return node


class Node4(Sorted):
    __slots__ = ()
    limit = 4

    def larger(self, *args):
        return Node16(*args)


class Node16(Sorted):
    __slots__ = ()
    limit = 16

    def larger(self, *args):
        return Node48(*args)


class Node48:
    """Up to 48 children in the order they came; a table tells each byte's place, 255 if it has none."""

    __slots__ = ("prefix", "row", "place", "kids")
    limit = 48

    def __init__(self, prefix: bytes = b"", row: int = -1):
        self.prefix, self.row, self.place, self.kids = prefix, row, bytearray(b"\xff" * 256), []

    def find(self, byte: int):
        at = self.place[byte]
        return self.kids[at] if at != 255 else None

    def full(self) -> bool:
        return len(self.kids) == self.limit

    def put(self, byte: int, child) -> None:
        at = self.place[byte]
        if at != 255:
            self.kids[at] = child
        else:
            self.place[byte] = len(self.kids)
            self.kids.append(child)

    def children(self):
        return [self.kids[at] for at in self.place if at != 255]

    def grown(self):
        node = Node256(self.prefix, self.row)
        for byte, at in enumerate(self.place):
            if at != 255:
                node.put(byte, self.kids[at])
        return node


class Node256:
    """A child or nothing for each byte."""

    __slots__ = ("prefix", "row", "kids")
    limit = 256

    def __init__(self, prefix: bytes = b"", row: int = -1):
        self.prefix, self.row, self.kids = prefix, row, [None] * 256

    def find(self, byte: int):
        return self.kids[byte]

    def full(self) -> bool:
        return False

    def put(self, byte: int, child) -> None:
        self.kids[byte] = child

    def children(self):
        return [child for child in self.kids if child is not None]


class Tree:
    """Distinct byte keys, each with the number of its row."""

    def __init__(self):
        self.root = Leaf()
        self.empty = True

    def insert(self, key: bytes, row: int) -> None:
        if self.empty:
            self.root, self.empty = Leaf(key, row), False
            return
        node, above, byte, at = self.root, None, 0, 0
        while True:
            prefix = node.prefix
            same, most = 0, min(len(prefix), len(key) - at)
            if key.startswith(prefix, at):
                same = len(prefix)
            else:
                while same < most and prefix[same] == key[at + same]:
                    same += 1
            if same < len(prefix):  # the compressed path branches, or the key ends within it
                fork = Node4(prefix[:same])
                node.prefix = prefix[same + 1 :]
                fork.put(prefix[same], node)
                if at + same == len(key):
                    fork.row = row
                else:
                    fork.put(key[at + same], Leaf(key[at + same + 1 :], row))
                self._replace(above, byte, fork)
                return
            at += same
            if at == len(key):
                node.row = row
                return
            child = node.find(key[at])
            if child is None:
                if node.full():
                    node = node.grown()
                    self._replace(above, byte, node)
                node.put(key[at], Leaf(key[at + 1 :], row))
                return
            above, byte, node, at = node, key[at], child, at + 1

    def _replace(self, above, byte: int, node) -> None:
        if above is None:
            self.root = node
        else:
            above.put(byte, node)

    def levels(self, width: int) -> tuple[list[int], list[int], list[int]]:
        """Nodes at depths that are multiples of ``width`` bytes, parents before children; the first is the root at depth 0.

        Returns the parent's index of each (-1 for the root), its depth in units of ``width``, and the row whose key ends there.
        """
        parents, depths, rows = [-1], [0], [-1]
        if self.empty:
            return parents, depths, rows
        todo = [(self.root, 0, 0)]
        while todo:
            node, at, above = todo.pop()
            end = at + len(node.prefix)
            for depth in range(max(1, -(-at // width)), end // width + 1):
                parents.append(above)
                depths.append(depth)
                rows.append(-1)
                above = len(parents) - 1
            if node.row >= 0:
                rows[above] = node.row
            for child in node.children():
                todo.append((child, end + 1, above))
        return parents, depths, rows

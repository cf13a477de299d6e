"""Errata tries in plain Python: which of a bounded set of strings differ by one character inserted, deleted or replaced.

The strings make up a trie; every branching node has a heavy child, the one with most strings below, and light children.
Light subtrees lose their first character and are merged, smallest first, into an errata trie, which then meets the heavy
subtree: strings that end in one place differ in that character. Subtrees that skip a character meet what stands beside
them. A string is in at most log2(n) light subtrees, and two subtrees meet only as far as both reach.
"""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A branching place. kids: by character, a Node or, for a single string, its rest and its ids; end: ids of what ends here."""

    __slots__ = ("kids", "end", "size")

    def __init__(self):
        self.kids: dict = {}
        self.end: list[int] | None = None
        self.size = 0


def put(root: Node, rest: str, ids: list[int]) -> None:
    node, k = root, 0
    while True:
        node.size += 1
        if k == len(rest):
            node.end = ids if node.end is None else node.end + ids
            return
        c = rest[k]
        kid = node.kids.get(c)
        k += 1
        if kid is None:
            node.kids[c] = (rest[k:], ids)
            return
        if type(kid) is tuple:
            if kid[0] == rest[k:]:
                node.kids[c] = (kid[0], kid[1] + ids)
                return
            fork = Node()
            put(fork, *kid)
            node.kids[c] = kid = fork
        node = kid


def look(node, rest: str) -> list[int] | None:
    """Ids of the string `rest` below a node."""
    for k, c in enumerate(rest):
        if type(node) is tuple:
            return node[1] if node[0] == rest[k:] else None
        if (node := node.kids.get(c)) is None:
            return None
    return (None if node[0] else node[1]) if type(node) is tuple else node.end


def meet(u, w) -> Iterator[tuple[list[int], list[int]]]:
    """Pairs of ids of strings that end in one place below both nodes."""
    stack = [(u, w)]
    while stack:
        u, w = stack.pop()
        if type(u) is tuple or type(w) is tuple:
            leaf, other = (u, w) if type(u) is tuple else (w, u)
            if (found := look(other, leaf[0])) is not None:
                yield (leaf[1], found) if leaf is u else (found, leaf[1])
            continue
        if u.end is not None and w.end is not None:
            yield u.end, w.end
        few, many = (u, w) if len(u.kids) <= len(w.kids) else (w, u)
        for c in few.kids:
            if c in many.kids:
                stack.append((u.kids[c], w.kids[c]))


def strings(node) -> Iterator[tuple[str, list[int]]]:
    """All strings below a node, with their ids."""
    stack = [("", node)]
    while stack:
        path, node = stack.pop()
        if type(node) is tuple:
            yield path + node[0], node[1]
            continue
        if node.end is not None:
            yield path, node.end
        stack.extend((path + c, kid) for c, kid in node.kids.items())


def _replaced(node: Node) -> Iterator[list[int]]:
    """Ids of strings that differ in the character at a node alone, two or more at a time."""
    kids = sorted(node.kids.values(), key=lambda x: 1 if type(x) is tuple else x.size)
    if len(kids) < 2:
        return
    *light, heavy = kids
    if len(light) == 1:
        yield from (a + b for a, b in meet(light[0], heavy))
        return
    merged = Node()
    for kid in light:
        for rest, ids in strings(kid):
            put(merged, rest, ids)
    for rest, ids in strings(merged):
        ids = ids + (look(heavy, rest) or [])
        if len(ids) > 1:
            yield ids


def _skipped(node: Node) -> Iterator[list[int]]:
    """Ids of two strings of which one has a character at a node more. Of a run of equal characters the last is skipped, so each pair comes once."""
    for c, kid in node.kids.items():
        if type(kid) is tuple:
            rest, ids = kid
            found = node.end if not rest else None if rest[0] == c or rest[0] not in node.kids else look(node.kids[rest[0]], rest[1:])
            if found is not None:
                yield ids + found
            continue
        if kid.end is not None and node.end is not None:
            yield kid.end + node.end
        few, many = (kid, node) if len(kid.kids) <= len(node.kids) else (node, kid)
        for d in few.kids:
            if d != c and d in many.kids:
                yield from (a + b for a, b in meet(kid.kids[d], node.kids[d]))


def one_edit(rests: list[str], depth: int, length: int) -> Iterator[list[int]]:
    """Lists of places in `rests` (distinct strings of `length` or one more character): all in a list are one edit from each other.

    A list has the strings of `length` that differ in one place, or one of them and one that is a character longer. Each
    pair whose common prefix is shorter than `depth` is in exactly one list.
    """
    root = Node()
    for i, s in enumerate(rests):
        put(root, s, [i])
    stack = [(root, 0)]
    while stack:
        node, d = stack.pop()
        for ids in _replaced(node):
            if len(rests[ids[0]]) == length:
                yield ids
        yield from _skipped(node)
        if d + 1 < depth:
            stack.extend((kid, d + 1) for kid in node.kids.values() if type(kid) is not tuple)

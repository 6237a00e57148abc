"""Deep-shallow suffix sorting in memory, down to a fixed depth.

Shallow: multikey quicksort on 8-byte digits, vectorized over all suffixes at once, to a
depth of 64 bytes; only ties go on to the next digit.  Deep: what is still tied shares a long
prefix, so each tied group is ordered by a blind trie, which looks at branching bytes only
and compares whole strings once per insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


class _Node:
    """A branching byte position, its children by byte, and a leaf below it."""

    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.children, self.leaf = depth, {}, leaf


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    if a == b:
        return len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of one length, and each one's common prefix with the one before it."""
    depth = len(strings[0])
    if len(strings) == 2:  # one branching at most
        return [0, 1] if strings[0] <= strings[1] else [1, 0], [0, common_prefix(*strings)]
    same: dict[int, list[int]] = {0: [0]}
    root: _Node | None = None
    for i in range(1, len(strings)):
        s = strings[i]
        if root is None:
            leaf = 0
        else:
            node: _Node | int = root
            while isinstance(node, _Node):  # blind: bytes between branchings are not looked at
                below = node.children.get(s[node.depth])
                node = node.leaf if below is None else below
            leaf = node
        at = common_prefix(s, strings[leaf])
        if at == depth:
            same[leaf].append(i)
            continue
        same[i] = [i]
        above, node = None, root if root is not None else 0
        while isinstance(node, _Node) and node.depth < at:
            above, node = node, node.children[s[node.depth]]
        if isinstance(node, _Node) and node.depth == at:
            node.children[s[at]] = i
            continue
        fork = _Node(at, i)
        inner = node.leaf if isinstance(node, _Node) else node
        fork.children = {strings[inner][at]: node, s[at]: i}
        if above is None:
            root = fork
        else:
            above.children[s[above.depth]] = fork
    order, shared = [], []

    def walk(node: _Node | int, lcp: int) -> None:
        stack: list[tuple[_Node | int, int]] = [(node, lcp)]
        while stack:
            here, before = stack.pop()
            if isinstance(here, _Node):
                keys = sorted(here.children)
                stack += [(here.children[k], before if k == keys[0] else here.depth) for k in reversed(keys)]
            else:
                members = same[here]
                order.extend(members)
                shared.extend([before] + [depth] * (len(members) - 1))

    walk(root if root is not None else 0, 0)
    return order, shared


def deep_shallow(text: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes text[start : start+depth] within each group.

    Returns the order (indices into start) and, for each place in it, whether the suffix
    equals the one before it (same group, common prefix of depth bytes).
    """
    order, common = sorted_suffixes(text, start, group, depth)
    return order, common == depth


def sorted_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes within each group, and each one's common prefix with the one before it.

    The common prefix is told if it has more than SHALLOW bytes (or the whole depth); else it is 0.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    rank = group[order]
    label = np.cumsum(np.concatenate([[0], rank[1:] != rank[:-1]])) if n else np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for at in range(0, min(SHALLOW, depth), 8):
        size = np.bincount(label) if n else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[label] > 1)
        if not len(tied):
            break
        place = start[order[tied]] + at
        digit = np.zeros(len(tied), np.uint64)
        for i in range(min(8, depth - at)):
            digit = digit << np.uint64(8) | padded[place + i].astype(np.uint64)
        by = np.lexsort((digit, label[tied]))
        order[tied] = order[tied][by]
        digit = digit[by]
        fresh = np.zeros(n, bool)
        fresh[tied[1:]] = digit[1:] != digit[:-1]
        fresh[1:] |= label[1:] != label[:-1]
        label = np.cumsum(fresh)
    common = np.zeros(n, np.int64)
    if n and depth > SHALLOW:
        size = np.bincount(label)
        head = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        raw = text.tobytes()
        for h, m in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            own = order[h : h + m]
            found, shared = blind_trie([raw[s : s + depth] for s in start[own].tolist()])
            order[h : h + m] = own[found]
            common[h + 1 : h + m] = shared[1:]
    elif n:
        common[1:] = np.where(label[1:] == label[:-1], depth, 0)
    return order, common

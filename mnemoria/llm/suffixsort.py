"""Deep-shallow sorting of byte strings: multikey quicksort, then blind tries.

Multikey quicksort splits on a few bytes at a time down to SHALLOW bytes. Strings that still agree there
form deep groups; a blind trie orders each: it branches on single bytes at known depths, a string is led
down without looking at the bytes between, and one comparison with the leaf it meets finds its place.
"""

from __future__ import annotations

#: Bytes that multikey quicksort looks at before the blind trie takes over, and bytes for each step.
SHALLOW, STEP = 16, 8


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix; the first `known` bytes agree."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("depth", "next")

    def __init__(self, depth: int):
        self.depth = depth  # the byte at this place decides; -1 stands for the end of a string
        self.next: dict[int, object] = {}


def _blind_trie(group: list[int], strings: list[bytes], depth: int) -> list[int]:
    """The group in order; all its strings agree on their first `depth` bytes."""
    at = lambda s, d: s[d] if d < len(s) else -1
    root: object = [group[0]]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, _Node):
            node = node.next.get(at(s, node.depth)) or next(iter(node.next.values()))
        common = lcp(s, strings[node[0]], depth)
        if common == len(s) == len(strings[node[0]]):
            node.append(i)
            continue
        old = at(strings[node[0]], common)
        parent, node = None, root
        while isinstance(node, _Node) and node.depth < common:
            parent, node = node, node.next[at(s, node.depth)]
        if isinstance(node, _Node) and node.depth == common:
            node.next[at(s, common)] = [i]
            continue
        split = _Node(common)
        split.next = {old: node, at(s, common): [i]}
        if parent is None:
            root = split
        else:
            parent.next[at(s, parent.depth)] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.next[c] for c in sorted(node.next, reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Indices of the strings in order; equal strings keep the order they came in."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            out += group
            continue
        if depth >= SHALLOW:
            out += _blind_trie(group, strings, depth)
            continue
        keys = [strings[i][depth : depth + STEP] for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
        same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
        more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
        stack.append((more, depth))
        if len(pivot) < STEP:  # the strings end here: they are equal
            stack += [([i], SHALLOW) for i in reversed(same)]
        else:
            stack.append((same, depth + STEP))
        stack.append((less, depth))
    return out


def sorted_lcps(strings: list[bytes], order: list[int]) -> list[int]:
    """LCP of each string in order with the one before it; 0 for the first."""
    return [0] + [lcp(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]

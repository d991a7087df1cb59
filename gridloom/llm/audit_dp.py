"""Cheapest edits that make a sequence of roles alternate, with the least audit string among equal costs.

The dynamic programme walks rows with four states: nothing put out yet, after a system row, after a user
row, after an assistant row. A state keeps its cheapest cost and its audit, a string that is never built:
audits are chains of linked nodes that share their beginnings. Every node has a rolling hash of its whole
string and ancestors at distances of powers of two, so two audits of equal cost are compared by a search for
the first nodes below their longest common beginning. Hashes that say "equal" are verified node by node
until both chains meet in one node, which they do at once unless a hash collided.

Edits of one row (insertions before it, then one letter of D, K or R) form a code in which no word begins
another one, so audits of as many rows differ within both and appending keeps their order: the least audit of
a state is all that later rows need. The same holds for the audits of whole pieces of rows, so pieces can
be solved apart, for every state they may begin in, and joined in order.
"""

from __future__ import annotations

from collections.abc import Iterable

_PRIME, _BASE = (1 << 61) - 1, 1_000_003

#: Costs of the edits, and of an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What an audit ends with, by (state, insertions) that end in an accepted state.
ENDS = [(START, ""), (ASSISTANT, ""), (USER, "I"), (START, "II"), (SYSTEM, "II")]


class Node:
    """The end of an audit: its last label, and the chain before it."""

    __slots__ = ("hash", "label", "up")

    def __init__(self, before: Node | None, label: str):
        self.label = label
        h = before.hash if before else 0
        for c in label:
            h = (h * _BASE + ord(c)) % _PRIME
        self.hash = h
        up: tuple[Node, ...] = (before,) if before else ()
        while up and len(up[-1].up) >= len(up):
            up += (up[-1].up[len(up) - 1],)
        self.up = up

    def labels(self) -> list[str]:
        out, node = [], self
        while node.up:
            out.append(node.label)
            node = node.up[0]
        return out[::-1]

    def text(self) -> str:
        return "".join(self.labels())


def _same(a: Node, b: Node) -> bool:
    """Whether chains of one length are equal label by label; ends where they meet."""
    while a is not b:
        if a.label != b.label:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` comes before that of ``b``; both chains have as many nodes."""
    if a is b:
        return False
    if a.hash == b.hash and _same(a, b):
        return False
    x, y = a, b
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if x.hash != y.hash and _same(x.up[0], y.up[0]):
        return x.label < y.label
    return a.labels() < b.labels()  # a hash collided


#: For the initial of a row's role, the ways into each state: (state before, label, cost).
_WAYS: dict[str, list[list[tuple[int, str, int]]]] = {}


def ways(initial: str) -> list[list[tuple[int, str, int]]]:
    """Into each state: from which one, by which label and at which cost, over a row that may stay."""
    if initial not in ("s", "u", "a"):
        initial = ""
    if initial not in _WAYS:
        into: list[list[tuple[int, str, int]]] = [[(q, "D", DELETE)] for q in range(4)]
        for q in range(4):
            reached, label = [(q, "")], ""
            for _ in range(2):  # more insertions at one place only come round to a state that was there before
                at = reached[-1][0]
                label += "I"
                reached.append((ASSISTANT if at == USER else USER, label))
            for at, before in reached:
                cost = INSERT * len(before)
                if initial in NEXT[at] and initial:
                    into[NEXT[at][initial]].append((q, before + "K", cost))
                to = ASSISTANT if at == USER else USER
                if NEXT[at].get(initial) != to:
                    into[to].append((q, before + "R", cost + REROLE))
        _WAYS[initial] = into
    return _WAYS[initial]


Cell = tuple[int, Node] | None


def _best(options: Iterable[tuple[int, Node, str]]) -> Cell:
    """The cheapest of (cost, chain before, label), of equal ones the least audit, as one new node."""
    top = None
    for cost, before, label in options:
        if top is None or cost < top[0]:
            top = (cost, before, label)
        elif cost == top[0] and (label < top[2] if before is top[1] else less(before, top[1])):
            top = (cost, before, label)
    return top and (top[0], Node(top[1], top[2]))


def step(cells: list[Cell], initial: str, must_go: bool, truncated: bool) -> list[Cell]:
    """The states after one more row."""
    if must_go:
        return deleted(cells, 1)
    more = TRUNCATED if truncated else 0
    return [
        _best((cells[q][0] + cost + (0 if label == "D" else more), cells[q][1], label) for q, label, cost in into if cells[q])
        for into in ways(initial)
    ]


def deleted(cells: list[Cell], n: int) -> list[Cell]:
    """The states after ``n`` rows that have to go."""
    return [c and (c[0] + DELETE * n, Node(c[1], "D" * n)) for c in cells]


def begin(state: int) -> list[Cell]:
    root = Node(None, "")
    return [(0, root) if q == state else None for q in range(4)]


def joined(cells: list[Cell], piece: list[list[tuple[int, str] | None]]) -> list[Cell]:
    """The states after a piece, given its (cost, audit) from each state to each."""
    return [
        _best((cells[q][0] + piece[q][to][0], cells[q][1], piece[q][to][1]) for q in range(4) if cells[q] and piece[q][to])
        for to in range(4)
    ]


def finished(cells: list[Cell]) -> tuple[int, str]:
    """Cost and audit of the cheapest way that ends well."""
    cost, node = _best((cells[q][0] + INSERT * len(label), cells[q][1], label) for q, label in ENDS if cells[q])
    return cost, node.text()

"""Cheapest edits of a conversation's roles, as a dynamic programme over shared edit prefixes.

A conversation is a string of row kinds: ``s``, ``u``, ``a`` for a sound row of that role initial, ``x`` for any other
initial, the same in capitals for a truncated row, and ``d`` for a row that must go. Its edits are written as initials:
Delete, Insert, Keep, Rerole. After some rows the roles so far are in one of four states, and each state needs only its
cheapest edits, the least string among equals. Those strings are not stored: an edit is a node linked to the edits before
it, so all states share what they have in common.

Two strings of equal cost are compared by their longest common prefix. Every node knows its ancestors 1, 2, 4, ... edits
back and a rolling hash of its whole string; the search goes back over ancestors whose hashes differ, until the parents'
hashes agree. Equal hashes are no proof, so the parents are followed back to a node that both strings share, and any
difference found on that way counts instead.

Among edits of the same rows that end in the same state at equal cost, none is the beginning of another (the longer would
hold inserts that cost more), so the least of them stays the least whatever follows. The same holds between segments.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What may follow: (role initial, next state). The roles of a whole conversation are nothing, or s?(ua)+.
FOLLOWS = {
    START: (("s", SYSTEM), ("u", USER)),
    SYSTEM: (("u", USER),),
    USER: (("a", ASSISTANT),),
    ASSISTANT: (("u", USER),),
}
#: What an edit can bring in: a row is inserted or given another role as user or assistant only.
FORCED = {state: next(to for role, to in steps if role != "s") for state, steps in FOLLOWS.items()}
FINAL = (START, ASSISTANT)
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
MODULUS = (1 << 61) - 1
BASE = 1_000_003


class Edit:
    """The last edit of a string of edits, linked to those before it."""

    __slots__ = ("hash", "initial", "length", "up")

    def __init__(self, before: Edit | None, initial: str, modulus: int = MODULUS):
        self.initial = initial
        if before is None:
            self.length, self.hash, self.up = 0, 0, ()
            return
        self.length = before.length + 1
        self.hash = (before.hash * BASE + ord(initial)) % modulus
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def text(self) -> str:
        out, node = [], self
        while node.length:
            out.append(node.initial)
            node = node.up[0]
        return "".join(reversed(out))


def ancestor(node: Edit, length: int) -> Edit:
    """The first ``length`` edits."""
    while node.length > length:
        node = node.up[(node.length - length).bit_length() - 1]
    return node


def less(a: Edit, b: Edit) -> bool:
    """Whether the string of ``a`` comes before that of ``b``."""
    shorter = min(a.length, b.length)
    x, y = ancestor(a, shorter), ancestor(b, shorter)
    if x.hash != y.hash:
        for k in reversed(range(len(x.up))):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
    first = None
    while x is not y:  # ends at once unless hashes collide: equal strings are one node
        if x.initial != y.initial:
            first = x, y
        x, y = x.up[0], y.up[0]
    return a.length < b.length if first is None else first[0].initial < first[1].initial


def _offer(cells: list, state: int, cost: int, before: Edit, initial: str, modulus: int) -> bool:
    have = cells[state]
    if have is not None and have[0] < cost:
        return False
    made = Edit(before, initial, modulus)
    if have is not None and have[0] == cost and not less(made, have[1]):
        return False
    cells[state] = (cost, made)
    return True


def _insert(cells: list, modulus: int) -> None:
    """Rows put in before the next one. Each costs something, so no state is passed twice."""
    changed = True
    while changed:
        changed = False
        for state in STATES:
            cell = cells[state]
            if cell is not None:
                to = cells[FORCED[state]]
                if to is None or to[0] >= cell[0] + INSERT_COST:
                    if to is not None and to[0] == cell[0] + INSERT_COST and to[1].up and to[1].up[0] is cell[1] and to[1].initial == "I":
                        continue
                    changed |= _offer(cells, FORCED[state], cell[0] + INSERT_COST, cell[1], "I", modulus)


def cheapest(kinds: str, entry: int = START, modulus: int = MODULUS) -> list[tuple[int, str] | None]:
    """For each state at the end: least cost and edits that lead there from ``entry``; None if none do."""
    cells: list = [None] * 4
    cells[entry] = (0, Edit(None, ""))
    _insert(cells, modulus)
    for kind in kinds:
        after: list = [None] * 4
        role, more = kind.lower(), TRUNCATED_COST if kind.isupper() else 0
        for state in STATES:
            if cells[state] is None:
                continue
            cost, before = cells[state]
            _offer(after, state, cost + DELETE_COST, before, "D", modulus)
            if kind == "d":
                continue
            for kept, to in FOLLOWS[state]:
                if kept == role:
                    _offer(after, to, cost + more, before, "K", modulus)
            _offer(after, FORCED[state], cost + REROLE_COST + more, before, "R", modulus)
        _insert(after, modulus)
        cells = after
    return [None if c is None else (c[0], c[1].text()) for c in cells]


#: Conversations of few rows are few different strings of kinds.
_short = lru_cache(maxsize=1 << 16)(cheapest)


def paths(kinds: str, entry: int = START) -> list[tuple[int, str] | None]:
    return _short(kinds, entry) if len(kinds) <= 24 else cheapest(kinds, entry)


class Chunk:
    """The edits of one segment, linked to those of the segments before it."""

    __slots__ = ("level", "text", "up")

    def __init__(self, before: Chunk | None, text: str):
        self.text, self.level = text, 0 if before is None else before.level + 1
        up, k = [] if before is None else [before], 0
        while up and k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)


def chunks_less(a: Chunk, b: Chunk) -> bool:
    """Compare the strings of two chains over equally many segments, from where they part."""
    x, y = a, b
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k] is not y.up[k]:
            x, y = x.up[k], y.up[k]
    shared = x.up[0] if x.up and x.up[0] is y.up[0] else None
    return _since(a, shared) < _since(b, shared)


def _since(node: Chunk | None, shared: Chunk | None) -> str:
    out = []
    while node is not None and node is not shared:
        out.append(node.text)
        node = node.up[0] if node.up else None
    return "".join(reversed(out))


def follow(cells: list, table: list[list[tuple[int, str] | None] | None]) -> list:
    """The cells (cost, chunk) after one more segment, whose ``table`` has the paths from each entry state."""
    after: list = [None] * 4
    for entry in STATES:
        if cells[entry] is None:
            continue
        cost, before = cells[entry]
        for state, found in enumerate(table[entry] or ()):
            if found is None:
                continue
            total, have = cost + found[0], after[state]
            if have is None or total <= have[0]:
                made = Chunk(before, found[1])
                if have is None or total < have[0] or chunks_less(made, have[1]):
                    after[state] = (total, made)
    return after


def best(cells: list) -> tuple[int, str]:
    """Least cost and its edits among the states in which a conversation may end."""
    ends = [cells[s] for s in FINAL if cells[s] is not None]
    cost = min(c for c, _ in ends)
    return cost, min(_since(chunk, None) for c, chunk in ends if c == cost)

"""Cheapest repairs of a sequence of turns: the auction algorithm for shortest paths on a lattice of integer costs.

A node (row, state) says how many rows are dealt with and what the kept turns look like: nothing yet, a system turn,
after a user turn, after an assistant turn. Arcs delete (3), keep (0) or rerole (2) the next row, or insert a turn (2);
a truncated row that stays adds 1. A path grows from its start; at its last node it is extended along the arc of least
cost plus price, or, where that is more than the node's price, the price rises to it and the path is cut back by one
node. When the path ends, an arc lies on a cheapest path only if it is tight: price = cost + price of its head.
Long sequences are solved in blocks, from the last to the first: the prices at the start of a block are the costs at
which the one before it is left.
"""

from __future__ import annotations

import functools

#: States between turns: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What remains to be paid at the end of a conversation in each state: nothing, or none can end there.
ENDS = (0, None, None, 0)
#: Rows of one block.
BLOCK_ROWS = 32
#: A row's code: its role (0 system, 1 user, 2 assistant, 3 another), 4 more if truncated, 8 if it must go.
MUST_GO, CUT = 8, 4
#: The state that a user or assistant turn leads to, by the state before it.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: Role codes that may be kept in each state, with the state they lead to.
KEPT = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, ASSISTANT: {1: USER}, USER: {2: ASSISTANT}}

Costs = tuple[int | None, ...]


def arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may become of the next row in `state`, by letter."""
    out = [("D", DELETE, state)]
    if code < MUST_GO:
        more = TRUNCATED if code & CUT else 0
        kept = KEPT[state].get(code & 3)
        if kept is not None:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


class Block:
    """Prices of one block's nodes; `exits` are the costs at which each state leaves it, None where it can't.

    In the last block turns may also be inserted after the last row. Nodes are numbered row * 4 + state; `goal` ends all paths.
    """

    def __init__(self, codes: bytes, exits: Costs, last: bool):
        n = len(codes)
        self.rows, self.goal = n, (n + 1) * STATES
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(self.goal)]
        for i, code in enumerate(codes):
            for q in range(STATES):
                own = [(letter, cost, (i + 1) * STATES + t) for letter, cost, t in arcs(code, q)]
                self.arcs[i * STATES + q] = [own[0], ("I", INSERT, i * STATES + NEXT[q]), *own[1:]]
        for q in range(STATES):
            node = self.arcs[n * STATES + q]
            if last:
                node.append(("I", INSERT, n * STATES + NEXT[q]))
            if exits[q] is not None:
                node.append(("", exits[q], self.goal))
        # Only nodes that reach the goal take part: a price could rise for ever at others.
        tails: list[list[int]] = [[] for _ in range(self.goal + 1)]
        for v, out in enumerate(self.arcs):
            for _, _, w in out:
                tails[w].append(v)
        live, open_ = {self.goal}, [self.goal]
        while open_:
            for v in tails[open_.pop()]:
                if v not in live:
                    live.add(v)
                    open_.append(v)
        self.arcs = [[a for a in out if a[2] in live] for out in self.arcs]
        self.live = live
        # First prices: what the rows still to come cost at least, whatever their neighbours are.
        least = min((c for c in exits if c is not None), default=0)
        self.price = [0] * (self.goal + 1)
        for i in range(n, -1, -1):
            if i < n:
                least += DELETE if codes[i] >= MUST_GO else TRUNCATED if codes[i] & CUT else 0
            for q in range(STATES):
                self.price[i * STATES + q] = least

    def solve(self, state: int) -> int | None:
        """Least cost from the block's first row in `state` to the goal; None where there is no way."""
        if state not in self.live:
            return None
        price, path = self.price, [state]
        while path[-1] != self.goal:
            v = path[-1]
            bid, head = min((cost + price[w], w) for _, cost, w in self.arcs[v])
            if bid > price[v]:
                price[v] = bid
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        return price[state]

    def trace(self, state: int) -> tuple[str, int]:
        """The least of the letter sequences of all tight paths from `state`, and the state in which it leaves."""
        price = self.price
        tight = [[a for a in out if price[v] == a[1] + price[a[2]]] for v, out in enumerate(self.arcs)]
        reach: dict[int, bool] = {self.goal: True}

        def reaches(v: int) -> bool:
            stack = [v]
            while stack:
                u = stack[-1]
                if u in reach:
                    stack.pop()
                    continue
                unknown = [w for _, _, w in tight[u] if w not in reach]
                if unknown and not any(reach.get(w) for _, _, w in tight[u]):
                    stack.append(unknown[0])  # tight arcs make no circle: all costs around one are positive
                else:
                    reach[u] = any(reach.get(w, False) for _, _, w in tight[u])
                    stack.pop()
            return reach[v]

        letters, v = [], state
        while v != self.goal:
            # The letter fixes the next state, so the smallest letter whose head still reaches the goal is the way.
            letter, _, head = min(a for a in tight[v] if reaches(a[2]))
            letters.append(letter)
            left, v = v, head
        return "".join(letters), left % STATES


@functools.lru_cache(maxsize=20_000)
def solved(codes: bytes, exits: Costs, last: bool, states: tuple[int, ...]) -> tuple[tuple[int | None, ...], tuple[tuple[str, int] | None, ...]]:
    """Costs of a block from each of `states`, and the cheapest way from each; short conversations repeat, so results are kept."""
    block = Block(codes, exits, last)
    costs = tuple(block.solve(q) for q in states)
    return costs, tuple(block.trace(q) if c is not None else None for q, c in zip(states, costs, strict=True))


def cheapest(codes: bytes, exits: Costs, last: bool, states: tuple[int, ...], block: int = BLOCK_ROWS) -> list[tuple[int, str, int] | None]:
    """(cost with exit, letters, exit state) of the cheapest way through `codes` from each of `states`; ties by the least letters."""
    cuts = list(range(0, len(codes), block)) or [0]
    ways: list[tuple[tuple[str, int] | None, ...]] = []
    costs: Costs = exits
    every = tuple(range(STATES))
    for start in reversed(cuts):
        asked = states if start == 0 else every
        costs, found = solved(codes[start : start + block], costs, last and start == cuts[-1], asked)
        ways.append(found)
    ways.reverse()
    out: list[tuple[int, str, int] | None] = []
    for k, q in enumerate(states):
        if costs[k] is None:
            out.append(None)
            continue
        letters, at = [], q
        for b, found in enumerate(ways):
            piece, at = found[k if b == 0 else at]
            letters.append(piece)
        out.append((costs[k], "".join(letters), at))
    return out


def crossing(codes: bytes, last: bool, block: int = BLOCK_ROWS) -> list[list[int | None]]:
    """Least cost from each state before `codes` to each state after it (to the end, four times over, if it is the last piece)."""
    if last:
        ends = [w and w[0] for w in cheapest(codes, ENDS, True, tuple(range(STATES)), block)]
        return [[c] * STATES for c in ends]
    columns = []
    for t in range(STATES):
        found = cheapest(codes, tuple(0 if q == t else None for q in range(STATES)), False, tuple(range(STATES)), block)
        columns.append([w and w[0] for w in found])
    return [[columns[t][q] for t in range(STATES)] for q in range(STATES)]

"""Regular expressions over bytes, compiled to minimal deterministic automata.

Syntax: literals, ``.``, ``\\xNN`` and escaped characters, classes, groups,
``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

Node = tuple


def parse(pattern: str, fold: bool = False) -> Node:
    """A tree of ('set', bytes), ('cat', nodes), ('alt', nodes) and ('rep', node, least, most or None)."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def char() -> int:
        c = take()
        if c != "\\":
            return ord(c)
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def folded(values: Iterable[int]) -> frozenset[int]:
        found = set(values)
        if fold:
            found |= {v ^ 0x20 for v in found if chr(v).isascii() and chr(v).isalpha()}
        return frozenset(found)

    def one_class() -> Node:
        negate = peek() == "^" and bool(take())
        found: set[int] = set()
        while peek() != "]":
            low = char()
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                found |= set(range(low, char() + 1))
            else:
                found.add(low)
        take()
        found = folded(found)
        return ("set", frozenset(range(256)) - found if negate else found)

    def atom() -> Node:
        c = peek()
        if c == "(":
            take()
            node = choice()
            take()
            return node
        if c == "[":
            take()
            return one_class()
        if c == ".":
            take()
            return ("set", frozenset(range(256)) - {10})
        return ("set", folded([char()]))

    def repeated() -> Node:
        node = atom()
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                end = pattern.index("}", at)
                bounds = pattern[at:end].split(",")
                skip(end + 1)
                least = int(bounds[0])
                most = least if len(bounds) == 1 else int(bounds[1]) if bounds[1] else None
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node

    def skip(to: int) -> None:
        nonlocal at
        at = to

    def sequence() -> Node:
        nodes = []
        while peek() and peek() not in "|)":
            nodes.append(repeated())
        return ("cat", nodes)

    def choice() -> Node:
        nodes = [sequence()]
        while peek() == "|":
            take()
            nodes.append(sequence())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    return choice()


def backwards(node: Node) -> Node:
    """The tree of the reversed words."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    return (node[0], [backwards(n) for n in (node[1][::-1] if node[0] == "cat" else node[1])])


class Nfa:
    """States with empty moves and moves on byte sets; ``accepts`` maps a state to a rule."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: Node, begin: int) -> int:
        """Adds the tree's states after ``begin``; returns its last state."""
        if node[0] == "set":
            end = self.state()
            self.moves[begin].append((node[1], end))
            return end
        if node[0] == "cat":
            for n in node[1]:
                begin = self.add(n, begin)
            return begin
        if node[0] == "alt":
            end = self.state()
            for n in node[1]:
                first = self.state()
                self.empty[begin].append(first)
                self.empty[self.add(n, first)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            begin = self.add(inner, begin)
        end = self.state()
        self.empty[begin].append(end)
        if most is None:
            first = self.state()
            self.empty[begin].append(first)
            last = self.add(inner, first)
            self.empty[last] += [first, end]
        else:
            for _ in range(most - least):
                begin = self.add(inner, begin)
                self.empty[begin].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


class Dfa:
    """``table[state, byte]`` is the next state; state 0 begins; ``accepts[state]`` has the rules that end there."""

    def __init__(self, table: np.ndarray, accepts: list[frozenset[int]]):
        self.table, self.accepts = table, accepts

    def dead(self) -> int:
        """A state that nothing leads out of, or -1."""
        for s, row in enumerate(self.table):
            if not self.accepts[s] and (row == s).all():
                return s
        return -1


def subsets(nfa: Nfa, begin: int) -> Dfa:
    """Subset construction, over classes of bytes that no rule tells apart."""
    kinds: dict[tuple, list[int]] = {}
    sets = list({m[0] for moves in nfa.moves for m in moves})
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    members = list(kinds.values())
    by_set = {s: [k for k, bs in enumerate(members) if bs[0] in s] for s in sets}
    first = nfa.closure([begin])
    number, order, rows = {first: 0}, [first], []
    for states in order:
        to: list[set[int]] = [set() for _ in members]
        for s in states:
            for on, t in nfa.moves[s]:
                for k in by_set[on]:
                    to[k].add(t)
        row, seen = [], {}
        for t in to:
            key = frozenset(t)
            if key not in seen:
                seen[key] = nfa.closure(key)
            full = seen[key]
            if full not in number:
                number[full] = len(order)
                order.append(full)
            row.append(number[full])
        rows.append(row)
    kind_of = np.zeros(256, np.int64)
    for k, bs in enumerate(members):
        kind_of[bs] = k
    table = np.array(rows, np.int32)[:, kind_of]
    return Dfa(table, [frozenset(nfa.accepts[s] for s in states if s in nfa.accepts) for states in order])


def minimised(dfa: Dfa) -> Dfa:
    """Merges the states that no continuation tells apart, by refinement of partitions."""
    labels = {a: k for k, a in enumerate(dict.fromkeys(dfa.accepts))}
    block = np.array([labels[a] for a in dfa.accepts])
    while True:
        _, new = np.unique(np.column_stack((block, block[dfa.table])), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    _, leader = np.unique(block, return_index=True)
    order = np.argsort(leader)  # the first block is that of state 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    leader = leader[order]
    return Dfa(rank[block[dfa.table[leader]]].astype(np.int32), [dfa.accepts[s] for s in leader])


def anchored(tree: Node) -> Dfa:
    """The minimal automaton of one rule, number 0."""
    nfa = Nfa()
    begin = nfa.state()
    nfa.accepts[nfa.add(tree, begin)] = 0
    return minimised(subsets(nfa, begin))


def combined(trees: list[Node]) -> Dfa:
    """One minimal automaton that says after each byte which rules have just been completed, wherever they began.

    Each rule's own automaton is cut at its first acceptance, so a rule is
    reported where its shortest match ends and not again for what it goes on to take.
    """
    nfa = Nfa()
    begin = nfa.state()
    nfa.moves[begin].append((frozenset(range(256)), begin))
    for rule, tree in enumerate(trees):
        own = anchored(tree)
        states = [nfa.state() for _ in own.accepts]
        nfa.empty[begin].append(states[0])
        dead = own.dead()
        for s, row in enumerate(own.table):
            if own.accepts[s]:
                nfa.accepts[states[s]] = rule
                continue
            for t in set(row.tolist()) - {dead}:
                nfa.moves[states[s]].append((frozenset(np.flatnonzero(row == t).tolist()), states[t]))
    return minimised(subsets(nfa, begin))

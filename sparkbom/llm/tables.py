"""Parse tables from a grammar text, and a parser that follows all table entries at once.

The grammar notation: one rule per unindented line ``name = alternatives``, continued by indented lines; quoted text and
NAMES IN CAPITALS are terminals; ``? * + ( ) |`` as usual. Tables are SLR(1); where an entry holds several actions the
parser keeps all of them in a graph-structured stack, so any context-free grammar can be written down as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


def _rules(text: str) -> tuple[str, dict[str, list[tuple[str, ...]]]]:
    """Start symbol and plain productions."""
    source: dict[str, str] = {}
    name = ""
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#\s.*", "", line)
        if line[:1].strip():
            name, _, body = line.partition("=")
            name = name.strip()
            source[name] = body
        elif line.strip():
            source[name] += " " + line
    out: dict[str, list[tuple[str, ...]]] = {}

    def fresh(alternatives: list[tuple[str, ...]], repeat: bool = False) -> str:
        aux = f"_{len(out)}_{len(source)}"
        out[aux] = alternatives + [(aux, *a) for a in alternatives] if repeat else alternatives
        return aux

    def choice(tokens: list[str]) -> list[tuple[str, ...]]:
        found: list[tuple[str, ...]] = []
        while True:
            rows: list[tuple[str, ...]] = [()]
            while tokens and tokens[0] not in "|)":
                token = tokens.pop(0)
                if token == "(":
                    inner = choice(tokens)
                    tokens.pop(0)
                    options = inner
                else:
                    options = [(token,)]
                mark = tokens.pop(0) if tokens and tokens[0] in "?*+" else ""
                if mark in ("*", "+"):
                    options = [(fresh(options, True),)]
                elif len(options) > 3:
                    options = [(fresh(options),)]
                if mark in ("?", "*"):
                    options = [(), *options]
                rows = [r + o for r in rows for o in options]
            found += rows
            if not tokens or tokens[0] == ")":
                return list(dict.fromkeys(found))
            tokens.pop(0)

    for name, body in source.items():
        out[name] = []
        alternatives = choice(re.findall(r"'[^']+'|\w+|[()|?*+]", body))
        out[name] = alternatives
    plain = lambda s: f"<{s}>" if s in out else s.strip("'")
    return plain(next(iter(source))), {plain(k): [tuple(map(plain, a)) for a in v] for k, v in out.items()}


class Tables:
    """``actions[state][terminal] = (shift state or -1, ((left side, length), ...))`` and ``goto[state][left side]``."""

    def __init__(self, text: str):
        start, rules = _rules(text)
        prods: list[tuple[str, tuple[str, ...]]] = [("<>", (start,))]
        of: dict[str, list[int]] = {}
        for left, rights in rules.items():
            of[left] = []
            for right in rights:
                if right != (left,):
                    of[left].append(len(prods))
                    prods.append((left, right))
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in of}
        follow: dict[str, set[str]] = {n: set() for n in of} | {"<>": {"<end>"}}
        changed = True
        while changed:
            changed = False
            for left, right in prods[1:]:
                if left not in nullable and all(s in nullable for s in right):
                    nullable.add(left)
                    changed = True
                for s in right:
                    new = first[s] if s in of else {s}
                    if not new <= first[left]:
                        first[left] |= new
                        changed = True
                    if s not in nullable:
                        break
        changed = True
        while changed:
            changed = False
            for left, right in prods:
                tail = follow[left]
                for s in reversed(right):
                    if s in of:
                        if not tail <= follow[s]:
                            follow[s] = follow[s] | tail
                            changed = True
                        tail = (tail | first[s]) if s in nullable else first[s]
                    else:
                        tail = {s}
        below = {n: self._closure(n, of, prods) for n in of}
        states: dict[frozenset, int] = {frozenset([(0, 0)]): 0}
        queue, self.actions, self.goto = [frozenset([(0, 0)])], [], []
        for kernel in queue:
            items = set(kernel)
            for p, dot in kernel:
                right = prods[p][1]
                if dot < len(right) and right[dot] in of:
                    items |= below[right[dot]]
            moves: dict[str, set] = {}
            reductions: dict[str, list] = {}
            for p, dot in items:
                left, right = prods[p]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((p, dot + 1))
                else:
                    for t in follow[left]:
                        reductions.setdefault(t, []).append((left, len(right)))
            shifts, gotos = {}, {}
            for symbol, target in moves.items():
                target = frozenset(target)
                if target not in states:
                    states[target] = len(queue)
                    queue.append(target)
                (gotos if symbol in of else shifts)[symbol] = states[target]
            self.actions.append({t: (shifts.get(t, -1), tuple(dict.fromkeys(reductions.get(t, ())))) for t in {*shifts, *reductions}})
            self.goto.append(gotos)
        self.units: dict[tuple[int, int, str], int] = {}
        self.terminals = {s for _, right in prods for s in right if s not in of}

    def renamed(self, below: int, state: int, terminal: str) -> int:
        """The state that ``state`` becomes on top of ``below`` by all reductions of one symbol that are sure before ``terminal``."""
        key = (below, state, terminal)
        to = self.units.get(key)
        if to is None:
            to = state
            while (act := self.actions[to].get(terminal)) and act[0] < 0 and len(act[1]) == 1 and act[1][0][1] == 1 and act[1][0][0] != "<>":
                to = self.goto[below][act[1][0][0]]
            self.units[key] = to
        return to

    @staticmethod
    def _closure(name: str, of: dict, prods: list) -> set:
        seen, todo = {name}, [name]
        while todo:
            for p in of[todo.pop()]:
                right = prods[p][1]
                if right and right[0] in of and right[0] not in seen:
                    seen.add(right[0])
                    todo.append(right[0])
        return {(p, 0) for n in seen for p in of[n]}


class Stack:
    """The graph-structured stack of one parse: nodes are [state, parents]."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.top: list[list] = [[0, []]]

    def accepts(self, terminal: str) -> bool:
        """Whether :meth:`push` would shift the terminal."""
        top, accepted = self.top, self.accepted
        ok = self.push((terminal,))
        self.top, self.accepted = top, accepted
        return ok

    def push(self, terminals: tuple[str, ...]) -> bool:
        """Shifts a token that may stand for any of ``terminals``; False, with the stack as before, if none is accepted."""
        actions, goto = self.t.actions, self.t.goto
        if len(self.top) == 1 and len(terminals) == 1:  # one linear stack: plain LR steps as long as they last
            node, terminal = self.top[0], terminals[0]
            while True:
                act = actions[node[0]].get(terminal)
                if act is None:
                    return False
                to, reductions = act
                if to >= 0 and not reductions:
                    self.top = [[to, [node]]]
                    return True
                if to >= 0 or len(reductions) > 1:
                    break
                left, n = reductions[0]
                if left == "<>":
                    self.accepted = True
                    return True
                below = node
                if n == 1 and len(node[1]) == 1:
                    below = node[1][0]
                    node = [self.t.renamed(below[0], node[0], terminal), node[1]]
                    continue
                while n and len(below[1]) == 1:
                    below = below[1][0]
                    n -= 1
                if n:
                    break
                node = [goto[below[0]][left], [below]]
        new: list[list] = []
        for terminal in terminals:
            for node in self._reduced(terminal):
                act = actions[node[0]].get(terminal)
                if act and act[0] >= 0:
                    for known in new:
                        if known[0] == act[0]:
                            known[1].append(node)
                            break
                    else:
                        new.append([act[0], [node]])
        if not new:
            return False
        self.top = new
        return True

    def _reduced(self, terminal: str) -> list[list]:
        """All tops after every sequence of reductions that the table allows before ``terminal``."""
        actions, goto = self.t.actions, self.t.goto
        tops = {node[0]: [node[0], list(node[1])] for node in self.top}
        queue, linked = list(tops.values()), False
        while queue:
            for node in queue:  # grows while new tops are found
                act = actions[node[0]].get(terminal)
                if not act:
                    continue
                sure = act[0] < 0 and len(act[1]) == 1
                for left, n in act[1]:
                    if left == "<>":
                        self.accepted = True
                        continue
                    ends = [node]
                    for _ in range(n):
                        ends = ends[0][1] if len(ends) == 1 else list({id(p): p for e in ends for p in e[1]}.values())
                    for end in ends:
                        state = self.t.renamed(end[0], node[0], terminal) if sure and n == 1 else goto[end[0]].get(left)
                        if state is None:
                            continue
                        known = tops.get(state)
                        if known is None:
                            tops[state] = known = [state, [end]]
                            queue.append(known)
                        elif all(p is not end for p in known[1]):
                            known[1].append(end)
                            linked = True
            # a link added to a known top may open further ways through it
            queue, linked = list(tops.values()) if linked else [], False
        return list(tops.values())

    accepted = False

    def finish(self) -> bool:
        """Whether the tokens so far are a whole sentence."""
        self.accepted = False
        self.push(("<end>",))
        return self.accepted


def parse(tables: Tables, tokens: Iterable[tuple[tuple[str, ...], int]]) -> int | None:
    """None if the tokens (terminals, line) form a sentence, else the line of the first token that cannot follow."""
    stack, line = Stack(tables), 1
    for terminals, line in tokens:
        if not stack.push(terminals):
            return line
    return None if stack.finish() else line

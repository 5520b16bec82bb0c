"""Generalised LL recognition over a graph-structured stack.

A grammar is a set of rules in an extended BNF.  Every rule becomes a
deterministic automaton over terminals and rule names, so common beginnings of
alternatives are walked once.  The recogniser is a worklist of descriptors
(state, stack node, position); stack nodes are shared by all calls of one rule
at one position, which makes left recursion and ambiguity harmless, and lets
the start rules of several dialects run together in one pass.

Token sequences are nested: what stands between brackets is a group, a single
token of its parent's sequence.  Equal groups are stored once and get a
number, and what is known of them (rule, group) -> accepted is kept, so the
shapes that recur all over a code collection are parsed once a worker.

Notation: ``Name = alternatives ;`` with ``|``, juxtaposition, ``( )``, ``?``,
``*`` and ``+``.  ``'x'`` and UPPER words are terminals; ``paren{Rule}``,
``brack{Rule}``, ``curly{Rule}``, ``block{Rule}`` and ``markup{Rule}`` are groups whose content
is a Rule (``AnyTokens``: whatever); EOS is an end of statement: a semicolon, a line end or the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

GROUPS = ("paren", "brack", "curly", "block", "markup")
_TOKEN = re.compile(r"\s*(?:(paren|brack|curly|block|markup)\{(\w+)\}|'([^']*)'|(\w+)|([=;|()?*+]))")
#: Groups and verdicts kept before a worker's memory of them is cleared.
MEMORY = 400_000
#: Groups within groups that are entered before the innermost is decided on its own and its parents begin again.
DEEP = 1_000


class _TooDeep(Exception):
    """Group ``number`` has to be decided as a ``rule`` before what holds it."""

    def __init__(self, rule: str, number: int) -> None:
        self.rule, self.number = rule, number


class State:
    __slots__ = ("accept", "terms", "rules", "groups", "eos")

    def __init__(self) -> None:
        self.accept = False
        self.terms: dict[str, State] = {}
        self.rules: list[tuple[str, State]] = []
        self.groups: dict[str, list[tuple[str, State]]] = {}
        self.eos: State | None = None


class _Nfa:
    """Thompson construction while a rule's right side is read."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[tuple | None, int]]] = []

    def new(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, b: int, symbol: tuple | None = None) -> None:
        self.edges[a].append((symbol, b))


def _read_rules(text: str) -> dict[str, list[tuple]]:
    text = re.sub(r"(?m)^\s*--.*$", "", text)
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        at = m.end()
        if m[1]:
            tokens.append(("group", m[1], m[2]))
        elif m[3] is not None:
            tokens.append(("term", m[3]))
        elif m[4]:
            tokens.append(("eos",) if m[4] == "EOS" else ("term", m[4]) if m[4].isupper() else ("rule", m[4]))
        else:
            tokens.append((m[5],))
    rules: dict[str, list[tuple]] = {}
    k = 0
    while k < len(tokens):
        name, end = tokens[k][1], tokens.index((";",), k)
        if tokens[k + 1] != ("=",):
            raise ValueError(f"grammar: no = after {name}")
        rules[name] = tokens[k + 2 : end]
        k = end + 1
    return rules


def _build_nfa(tokens: list[tuple]) -> tuple[_Nfa, int, int]:
    nfa, at = _Nfa(), 0

    def alternatives() -> tuple[int, int]:
        nonlocal at
        start, stop = nfa.new(), nfa.new()
        while True:
            a, b = sequence()
            nfa.link(start, a)
            nfa.link(b, stop)
            if at < len(tokens) and tokens[at] == ("|",):
                at += 1
                continue
            return start, stop

    def sequence() -> tuple[int, int]:
        nonlocal at
        start = here = nfa.new()
        while at < len(tokens) and tokens[at] not in (("|",), (")",)):
            token = tokens[at]
            at += 1
            if token == ("(",):
                a, b = alternatives()
                at += 1
            else:
                a, b = nfa.new(), nfa.new()
                nfa.link(a, b, token)
            while at < len(tokens) and tokens[at] in (("?",), ("*",), ("+",)):
                mark = tokens[at][0]
                at += 1
                c, d = nfa.new(), nfa.new()
                nfa.link(c, a)
                nfa.link(b, d)
                if mark in "?*":
                    nfa.link(c, d)
                if mark in "*+":
                    nfa.link(b, a)
                a, b = c, d
            nfa.link(here, a)
            here = b
        return start, here

    start, stop = alternatives()
    return nfa, start, stop


def _determinise(nfa: _Nfa, start: int, stop: int) -> State:
    def closure(states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for symbol, to in nfa.edges[todo.pop()]:
                if symbol is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    first = closure([start])
    made = {first: State()}
    todo = [first]
    while todo:
        some = todo.pop()
        state = made[some]
        state.accept = stop in some
        moves: dict[tuple, set[int]] = {}
        for s in some:
            for symbol, to in nfa.edges[s]:
                if symbol is not None:
                    moves.setdefault(symbol, set()).add(to)
        for symbol, to in moves.items():
            target = closure(to)
            if target not in made:
                made[target] = State()
                todo.append(target)
            if symbol[0] == "term":
                state.terms[symbol[1]] = made[target]
            elif symbol[0] == "rule":
                state.rules.append((symbol[1], made[target]))
            elif symbol[0] == "eos":
                state.eos = made[target]
            else:
                state.groups.setdefault(symbol[1], []).append((symbol[2], made[target]))
    return made[first]


class Grammar:
    """Compiled rules of one language; ``lists`` are rules whose concatenation is the rule again."""

    def __init__(self, text: str, lists: Iterable[str], continues: Iterable[str] = (), by_line: bool = False) -> None:
        rules = _read_rules(text)
        self.start: dict[str, State] = {name: _determinise(*_build_nfa(tokens)) for name, tokens in rules.items()}
        for tokens in rules.values():
            for t in tokens:
                used = t[1] if t[0] == "rule" else t[2] if t[0] == "group" else None
                if used is not None and used != "AnyTokens" and used not in self.start:
                    raise ValueError(f"grammar: no rule {used}")
        self.lists = frozenset(lists)
        self.continues = frozenset(continues)
        self.by_line = by_line
        self.first: dict[str, frozenset[str] | None] = {}
        self._first_sets()
        self.numbers: dict[tuple, int] = {}
        self.contents: list[tuple] = []
        self.known: dict[tuple, bool] = {}
        self.depth = 0

    def _first_sets(self) -> None:
        """First tokens of every rule; None where it can be empty (or end at a line end)."""
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.start}
        changed = True
        while changed:
            changed = False
            for name, start in self.start.items():
                seen, todo, got, empty = {id(start)}, [start], set(), False
                while todo:
                    state = todo.pop()
                    empty |= state.accept
                    got.update(state.terms)
                    got.update(state.groups)
                    if state.eos is not None:
                        empty = True
                    for rule, then in state.rules:
                        got |= first[rule]
                        if rule in nullable and id(then) not in seen:
                            seen.add(id(then))
                            todo.append(then)
                if not got <= first[name]:
                    first[name] |= got
                    changed = True
                if empty and name not in nullable:
                    nullable.add(name)
                    changed = True
        self.first = {n: None if n in nullable else frozenset(f) for n, f in first.items()}

    def forget(self) -> None:
        """Clear what is known once it has grown beyond its bound; call between texts only."""
        if len(self.contents) + len(self.known) > MEMORY:
            self.numbers.clear()
            self.contents.clear()
            self.known.clear()

    def group(self, content: list) -> int:
        """The number of a group's content."""
        key = tuple(content)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.contents)
            self.contents.append(key)
        return number

    def accepts(self, rule: str, number: int) -> bool:
        """Whether a group's content is a ``rule``."""
        if rule == "AnyTokens":
            return True
        key = (rule, number)
        known = self.known.get(key)
        if known is None:
            if self.depth >= DEEP:
                raise _TooDeep(rule, number)
            self.depth += 1
            try:
                known = self.known[key] = self.derives((rule,), self.contents[number])
            finally:
                self.depth -= 1
        return known

    def accepts_one(self, rules: tuple[str, ...], number: int) -> bool:
        """Whether a group's content is one of ``rules``, the dialects of a text."""
        todo = [(rules, number)]
        while True:
            some, at = todo[-1]
            try:
                known = self.accepts(some[0], at) if len(some) == 1 else self.derives(some, self.contents[at])
            except _TooDeep as inner:
                todo.append(((inner.rule,), inner.number))
                continue
            todo.pop()
            if not todo:
                return known

    def derives(self, rules: tuple[str, ...], content: tuple) -> bool:
        if len(content) > 1 and not self.lists.isdisjoint(rules):
            parts = self._parts(content)
            if len(parts) > 1:
                # one dialect has to hold for all parts
                if any(rule in self.lists and all(self._part(rule, p) for p in parts) for rule in rules):
                    return True
                # a cut may have been wrong: the whole sequence decides
        return self.recognise(rules, content)

    def _part(self, rule: str, part: tuple) -> bool:
        key = (rule, part)
        known = self.known.get(key)
        if known is None:
            known = self.known[key] = self.recognise((rule,), part)
        return known

    def _parts(self, content: tuple) -> list[tuple]:
        """Cut a sequence of statements after semicolons and after blocks that nothing continues."""
        parts, start, n, goes_on, by_line = [], 0, len(content), self.continues, self.by_line
        for i, token in enumerate(content):
            if token == ";" or token == "\n;" or (type(token) is tuple and token[0] in ("curly", "block", "\ncurly")):
                if i + 1 < n:
                    following = content[i + 1]
                    kind = following if type(following) is str else following[0]
                    if kind.lstrip("\n") in goes_on or (by_line and kind[0] != "\n" and type(token) is tuple):
                        continue
                parts.append(content[start : i + 1])
                start = i + 1
        if start < n:
            parts.append(content[start:])
        return parts

    def recognise(self, rules: Iterable[str], content: tuple) -> bool:
        """Whether the whole content is one of ``rules``; all of them run on one stack."""
        n = len(content)
        kinds, line = [], []
        for token in content:
            kind = token if type(token) is str else token[0]
            line.append(kind[0] == "\n" and len(kind) > 1)
            kinds.append(kind.lstrip("\n") if len(kind) > 1 else kind)
        first, start = self.first, self.start
        nodes: dict[tuple[str, int], tuple[list, set[int]]] = {}
        seen: set[tuple[int, int, int]] = set()
        todo: list[tuple[State, tuple, int]] = []

        def add(state: State, node: tuple, pos: int) -> None:
            key = (id(state), id(node), pos)
            if key not in seen:
                seen.add(key)
                todo.append((state, node, pos))

        roots = []
        for rule in rules:
            node = nodes[rule, 0] = ([], set())
            roots.append(node)
            add(start[rule], node, 0)
        while todo:
            state, node, pos = todo.pop()
            if state.accept and pos not in node[1]:
                node[1].add(pos)
                if pos == n and any(node is r for r in roots):
                    return True
                for then, parent in node[0]:
                    add(then, parent, pos)
            kind = kinds[pos] if pos < n else None
            if kind is not None:
                then = state.terms.get(kind)
                if then is not None:
                    add(then, node, pos + 1)
                choices = state.groups.get(kind)
                if choices is not None:
                    for rule, then in choices:
                        if self.accepts(rule, content[pos][1]):
                            add(then, node, pos + 1)
            if state.eos is not None:
                if kind == ";":
                    add(state.eos, node, pos + 1)
                elif kind is None or line[pos]:
                    add(state.eos, node, pos)
            for rule, then in state.rules:
                begins = first[rule]
                if begins is not None and kind not in begins:
                    continue
                child = nodes.get((rule, pos))
                if child is None:
                    child = nodes[rule, pos] = ([(then, node)], set())
                    add(start[rule], child, pos)
                elif not any(t is then and p is node for t, p in child[0]):
                    child[0].append((then, node))
                    for end in tuple(child[1]):
                        add(then, node, end)
        return False

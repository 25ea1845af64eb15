"""Packrat parsing expression grammars: grammar text to a memoising recogniser with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

_TOKEN = re.compile(
    r"""\s*(?:(?P<define>\w+)\s*<-|(?P<regex>~"(?:[^"\\]|\\.)*")|(?P<literal>'(?:[^'\\]|\\.)*')|(?P<name>\w+)|(?P<op>[/()*+?&!]))"""
)


@dataclass(frozen=True)
class Node:
    """A rule that matched text[begin:end]; value is what the rule's action made of it."""

    rule: str
    begin: int
    end: int
    children: tuple[Node, ...] = field(default=())
    value: Any = None

    def find(self, *rules: str) -> Node | None:
        """The first node of one of the rules, in reading order."""
        for child in self.children:
            if child.rule in rules:
                return child
            deeper = child.find(*rules)
            if deeper is not None:
                return deeper
        return None

    def parts(self, rule: str) -> list[Node]:
        """Direct children of the rule."""
        return [c for c in self.children if c.rule == rule]


#: A matcher gives (end, nodes) or None; the memo holds every rule's result by position.
#: An action is called with the text and the node of its rule when the rule has matched.
Action = Callable[[str, Node], Any]
Matcher = Callable[[str, int, dict], "tuple[int, tuple[Node, ...]] | None"]


class Grammar:
    """A grammar text of lines ``rule <- expression``; the first rule is the start.

    Expressions: sequence by juxtaposition, ordered choice with /, suffixes * + ?, predicates & !,
    groups in parentheses, 'literals', ~"regular expressions" (dot matches line ends) and rules.
    Every rule is tried at most once per position, so parsing takes time linear in the text.
    """

    def __init__(self, text: str, actions: dict[str, Action] | None = None) -> None:
        self._actions = actions or {}
        self._tokens = [m for m in _TOKEN.finditer(text.strip())]
        self._at = 0
        self._rules: dict[str, Matcher] = {}
        self.start = ""
        while self._at < len(self._tokens):
            name = self._take("define")
            self.start = self.start or name
            self._rules[name] = self._memoised(name, self._choice())

    def parse(self, text: str) -> Node | None:
        """The start rule at offset 0; None if it does not match there. The end need not be reached."""
        got = self._rules[self.start](text, 0, {})
        return got[1][0] if got else None

    def _peek(self, kind: str, value: str | None = None) -> str | None:
        if self._at >= len(self._tokens):
            return None
        got = self._tokens[self._at].group(kind)
        return got if got is not None and (value is None or got in value) else None

    def _take(self, kind: str) -> str:
        got = self._peek(kind)
        if got is None:
            raise ValueError(f"expected {kind} at token {self._at}")
        self._at += 1
        return got

    def _choice(self) -> Matcher:
        options = [self._sequence()]
        while self._peek("op", "/"):
            self._at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]

        def match(text: str, pos: int, memo: dict):
            for option in options:
                got = option(text, pos, memo)
                if got is not None:
                    return got
            return None

        return match

    def _sequence(self) -> Matcher:
        items = []
        while self._at < len(self._tokens) and not self._peek("define") and not self._peek("op", "/)"):
            items.append(self._prefixed())
        if len(items) == 1:
            return items[0]

        def match(text: str, pos: int, memo: dict):
            nodes: tuple[Node, ...] = ()
            for item in items:
                got = item(text, pos, memo)
                if got is None:
                    return None
                pos, more = got
                nodes += more
            return pos, nodes

        return match

    def _prefixed(self) -> Matcher:
        sign = self._peek("op", "&!")
        if not sign:
            return self._suffixed()
        self._at += 1
        inner, wanted = self._suffixed(), sign == "&"
        return lambda text, pos, memo: (pos, ()) if (inner(text, pos, memo) is not None) == wanted else None

    def _suffixed(self) -> Matcher:
        inner = self._primary()
        sign = self._peek("op", "*+?")
        if not sign:
            return inner
        self._at += 1
        least, most = (1 if sign == "+" else 0), (1 if sign == "?" else None)

        def match(text: str, pos: int, memo: dict):
            nodes: tuple[Node, ...] = ()
            times = 0
            while most is None or times < most:
                got = inner(text, pos, memo)
                if got is None or got[0] == pos:
                    break
                pos, more = got
                nodes += more
                times += 1
            return (pos, nodes) if times >= least else None

        return match

    def _primary(self) -> Matcher:
        if self._peek("op", "("):
            self._at += 1
            inner = self._choice()
            if not self._peek("op", ")"):
                raise ValueError(f"unclosed group at token {self._at}")
            self._at += 1
            return inner
        if self._peek("regex"):
            pattern = re.compile(self._take("regex")[2:-1].replace('\\"', '"'), re.S)

            def terminal(text: str, pos: int, memo: dict):
                m = pattern.match(text, pos)
                return (m.end(), ()) if m else None

            return terminal
        if self._peek("literal"):
            word = self._take("literal")[1:-1].replace("\\'", "'")
            return lambda text, pos, memo: (pos + len(word), ()) if text.startswith(word, pos) else None
        name = self._take("name")
        return lambda text, pos, memo: self._rules[name](text, pos, memo)

    def _memoised(self, name: str, inner: Matcher) -> Matcher:
        action = self._actions.get(name)

        def match(text: str, pos: int, memo: dict):
            key = (name, pos)
            if key in memo:
                return memo[key]
            memo[key] = None  # left recursion fails instead of looping
            got = inner(text, pos, memo)
            if got is None:
                return None
            node = Node(name, pos, got[0], got[1])
            if action is not None:
                node = Node(name, pos, got[0], got[1], action(text, node))
            memo[key] = result = (got[0], (node,))
            return result

        return match

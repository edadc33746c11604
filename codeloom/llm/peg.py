"""Packrat parsing of expression grammars: ordered choice, unlimited lookahead, each rule parsed once per place.

An expression is a function (parser, position) -> end position or -1. Actions are called with the offsets of what
they name when their rule has matched.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Expression = Callable[["Packrat", int], int]


class Packrat:
    """One text under one grammar; `memo` holds the end of every rule tried at every place."""

    def __init__(self, rules: dict[str, Expression], text: str):
        self.rules, self.text = rules, text
        self.memo: dict[tuple[str, int], tuple[int, dict[str, tuple[int, int]]]] = {}
        self.names: dict[str, tuple[int, int]] = {}

    def parse(self, rule: str, at: int) -> int:
        key = (rule, at)
        known = self.memo.get(key)
        if known is None:
            outer, self.names = self.names, {}
            end = self.rules[rule](self, at)
            known = self.memo[key] = (end, self.names if end >= 0 else {})
            self.names = outer
        if known[1]:
            self.names.update(known[1])
        return known[0]


def token(pattern: str) -> Expression:
    match = re.compile(pattern).match

    def run(p: Packrat, at: int) -> int:
        m = match(p.text, at)
        return m.end() if m else -1

    return run


def nested(name: str, open_: str, close: str, other: str) -> Expression:
    """A bracketed text, brackets of its kind nested to any depth, `other` skipped between them; every pair is remembered."""
    match = re.compile(other).match

    def run(p: Packrat, at: int) -> int:
        text, memo = p.text, p.memo
        if not text.startswith(open_, at):
            return -1
        open_at: list[int] = []
        i = at
        while True:
            if text.startswith(open_, i):
                known = memo.get((name, i))
                if known is None:
                    open_at.append(i)
                    i += 1
                    continue
                i = known[0]
            elif text.startswith(close, i):
                i += 1
                memo[name, open_at.pop()] = (i, {})
            else:
                m = match(text, i)
                i = m.end() if m and m.end() > i else -1
            if i < 0:
                for begun in open_at:
                    memo[name, begun] = (-1, {})
                return -1
            if not open_at:
                return i

    return run


def rule(name: str) -> Expression:
    return lambda p, at: p.parse(name, at)


def seq(*parts: Expression) -> Expression:
    def run(p: Packrat, at: int) -> int:
        for part in parts:
            at = part(p, at)
            if at < 0:
                return -1
        return at

    return run


def choice(*parts: Expression) -> Expression:
    def run(p: Packrat, at: int) -> int:
        for part in parts:
            end = part(p, at)
            if end >= 0:
                return end
        return -1

    return run


def star(part: Expression) -> Expression:
    def run(p: Packrat, at: int) -> int:
        while (end := part(p, at)) > at:
            at = end
        return at

    return run


def maybe(part: Expression) -> Expression:
    return lambda p, at: max(at, part(p, at))


def named(name: str, part: Expression) -> Expression:
    def run(p: Packrat, at: int) -> int:
        end = part(p, at)
        if end >= 0:
            p.names[name] = (at, end)
        return end

    return run

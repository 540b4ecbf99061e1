"""Memoised parsing with derivatives.

A language is a node: nothing, the empty word, a token, alternatives, a sequence, a repetition or a reference to a
rule. The derivative of a language by a token is what may follow that token. Nodes are interned, so equal languages are
one object, and each keeps its derivatives: a file costs a look-up per token wherever its worker has met the same
situation before, in this file or another. An empty derivative marks the failing token; a language that is not
nullable after the last token means that the text was cut off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class Node:
    __slots__ = ("kind", "a", "b", "nullable", "d")

    def __init__(self, kind: str, a=None, b=None, nullable: bool = False):
        self.kind, self.a, self.b, self.nullable = kind, a, b, nullable
        self.d: dict[str, Node] = {}


@dataclass(frozen=True)
class Failure:
    """``token``: the index of the failing token, or the number of tokens where the text ended too early."""

    token: int
    truncated: bool


class Grammar:
    """Rules in EBNF: ``name: 'literal' KIND other (a | b)? c* d+ ;`` one after the other, without left recursion."""

    def __init__(self, text: str, start: str, limit: int = 400_000):
        self.text, self.start_rule, self.limit = text, start, limit
        self._build()

    def _build(self) -> None:
        self._table: dict[tuple, Node] = {}
        self.none, self.empty = Node("none"), Node("empty", nullable=True)
        self.rules: dict[str, Node] = {}
        trees = _read(self.text)
        nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for name, tree in trees.items():
                if name not in nullable and _nullable(tree, nullable):
                    nullable.add(name)
                    grown = True
        self._refs = {name: Node("ref", name, nullable=name in nullable) for name in trees}
        for name, tree in trees.items():
            self.rules[name] = self._make(tree)
        self.start = self._refs[self.start_rule]

    def _make(self, tree) -> Node:
        op, *rest = tree
        if op == "tok":
            return self._node("tok", rest[0])
        if op == "ref":
            return self._refs[rest[0]]
        if op == "seq":
            out = self.empty
            for t in reversed(rest[0]):
                out = self.seq(self._make(t), out)
            return out
        if op == "alt":
            return self.alt([self._make(t) for t in rest[0]])
        inner = self._make(rest[0])
        if op == "?":
            return self.alt([inner, self.empty])
        star = self._node("star", inner, nullable=True)
        return star if op == "*" else self.seq(inner, star)

    def _node(self, kind: str, a=None, b=None, nullable: bool = False) -> Node:
        key = (kind, a, b)
        node = self._table.get(key)
        if node is None:
            node = self._table[key] = Node(kind, a, b, nullable)
        return node

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.none or b is self.none:
            return self.none
        if a is self.empty:
            return b
        if b is self.empty:
            return a
        if a.kind == "seq":  # to the right, so that what is still to come is shared
            return self.seq(a.a, self.seq(a.b, b))
        return self._node("seq", a, b, a.nullable and b.nullable)

    def alt(self, parts: list[Node]) -> Node:
        flat: dict[Node, None] = {}
        for p in parts:
            for q in p.a if p.kind == "alt" else (p,):
                if q is not self.none:
                    flat[q] = None
        if not flat:
            return self.none
        if len(flat) == 1:
            return next(iter(flat))
        return self._node("alt", frozenset(flat), None, any(q.nullable for q in flat))

    def derive(self, n: Node, t: str) -> Node:
        out = n.d.get(t)
        if out is None:
            kind = n.kind
            if kind == "tok":
                out = self.empty if n.a == t else self.none
            elif kind == "ref":
                out = self.derive(self.rules[n.a], t)
            elif kind == "seq":
                out = self.seq(self.derive(n.a, t), n.b)
                if n.a.nullable:
                    out = self.alt([out, self.derive(n.b, t)])
            elif kind == "alt":
                out = self.alt([self.derive(p, t) for p in n.a])
            elif kind == "star":
                out = self.seq(self.derive(n.a, t), n)
            else:
                out = self.none
            n.d[t] = out
        return out

    def check(self, tokens: list[tuple[str, bool]], insert: str | None = None) -> Failure | None:
        """None if the kinds of ``tokens`` are a word of the grammar. With ``insert``, this token is supplied before a
        token that does not fit and stands on a new line or closes a block, and at the end."""
        if len(self._table) > self.limit:
            self._build()
        state, none = self.start, self.none
        for i, (kind, new_line) in enumerate(tokens):
            after = state.d.get(kind)
            if after is None:
                after = self.derive(state, kind)
            if after is none and insert and (new_line or kind == "}"):
                after = self.derive(self.derive(state, insert), kind)
            if after is none:
                return Failure(i, False)
            state = after
        if state.nullable or (insert and self.derive(state, insert).nullable):
            return None
        return Failure(len(tokens), True)


_EBNF = re.compile(r"(?:\s|#[^\n]*\n)*('[^']+'|[A-Za-z_]\w*|[()|*+?:;])")


def _read(text: str) -> dict[str, tuple]:
    """Rules as trees; names in capitals and quoted literals are tokens."""
    words, at = [], 0
    while m := _EBNF.match(text, at):
        words.append(m[1])
        at = m.end()
    assert not text[at:].strip(), f"bad grammar at {text[at : at + 40]!r}"
    i = 0

    def alternatives():
        nonlocal i
        parts = [sequence()]
        while words[i] == "|":
            i += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal i
        parts = []
        while words[i] not in ("|", ")", ";"):
            w = words[i]
            i += 1
            if w == "(":
                item = alternatives()
                i += 1
            elif w[0] == "'":
                item = ("tok", w[1:-1])
            else:
                item = ("tok" if w.isupper() else "ref", w)
            while words[i] in ("*", "+", "?"):
                item = (words[i], item)
                i += 1
            parts.append(item)
        return ("seq", parts)

    rules = {}
    while i < len(words):
        name = words[i]
        i += 2
        rules[name] = alternatives()
        i += 1
    return rules


def _nullable(tree, names: set[str]) -> bool:
    op, *rest = tree
    if op == "tok":
        return False
    if op == "ref":
        return rest[0] in names
    if op == "seq":
        return all(_nullable(t, names) for t in rest[0])
    if op == "alt":
        return any(_nullable(t, names) for t in rest[0])
    return op in "*?" or _nullable(rest[0], names)

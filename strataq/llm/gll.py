"""Generalised LL parsing with a graph-structured stack, and recovery from errors.

Descriptors (rule position, stack node, token) are worked off one by one; calls of a rule at a token share a node of the
stack, so ambiguous and left-recursive grammars take polynomial time. ``islands`` finds all matches of a rule in a text:
where the rule fails the parse goes on behind the token at which it was tried, so what is whole is found in broken files.
"""

from __future__ import annotations

from dataclasses import dataclass

from strataq.llm.derivatives import _read


@dataclass(frozen=True)
class Slot:
    """A place in a rule's body: tok, any, call, fork or end."""

    kind: str
    value: str = ""
    after: tuple[int, ...] = ()


class _Call:
    """A node of the stack: a rule called at a token, with the ways back and where the rule ended so far."""

    __slots__ = ("back", "ends")

    def __init__(self):
        self.back: set = set()
        self.ends: set[int] = set()


class GLL:
    """``name: ... ;`` rules as in the grammars for derivatives. ANY stands for any token but those in ``never``."""

    def __init__(self, text: str, never: frozenset[str] = frozenset()):
        self.slots: list[Slot] = []
        self.entry: dict[str, int] = {}
        self.never = never
        for name, tree in _read(text).items():
            self.entry[name] = self._compile(tree, self._add(Slot("end")))

    def _add(self, s: Slot) -> int:
        self.slots.append(s)
        return len(self.slots) - 1

    def _compile(self, tree, then: int) -> int:
        op, *rest = tree
        if op == "tok":
            return self._add(Slot("any" if rest[0] == "ANY" else "tok", rest[0], (then,)))
        if op == "ref":
            return self._add(Slot("call", rest[0], (then,)))
        if op == "seq":
            for t in reversed(rest[0]):
                then = self._compile(t, then)
            return then
        if op == "alt":
            return self._add(Slot("fork", "", tuple(self._compile(t, then) for t in rest[0])))
        if op == "?":
            return self._add(Slot("fork", "", (self._compile(rest[0], then), then)))
        fork = self._add(Slot("fork"))
        body = self._compile(rest[0], fork)
        self.slots[fork] = Slot("fork", "", (body, then))
        return fork if op == "*" else body

    def ends(self, kinds: list[str], rule: str, start: int) -> set[int]:
        """Where ``rule`` may end when it begins at the token ``start``; empty if it does not match there."""
        calls: dict[tuple[str, int], _Call] = {}
        work: list[tuple[int, _Call, int]] = []
        seen: set[tuple[int, _Call, int]] = set()

        def add(slot: int, call: _Call, at: int) -> None:
            if (slot, call, at) not in seen:
                seen.add((slot, call, at))
                work.append((slot, call, at))

        root = calls[rule, start] = _Call()
        add(self.entry[rule], root, start)
        while work:
            slot, call, at = work.pop()
            s = self.slots[slot]
            if s.kind == "fork":
                for a in s.after:
                    add(a, call, at)
            elif s.kind == "end":
                if at not in call.ends:
                    call.ends.add(at)
                    for after, caller in call.back:
                        add(after, caller, at)
            elif s.kind == "call":
                callee = calls.get((s.value, at))
                if callee is None:
                    callee = calls[s.value, at] = _Call()
                    add(self.entry[s.value], callee, at)
                if (s.after[0], call) not in callee.back:
                    callee.back.add((s.after[0], call))
                    for e in callee.ends:
                        add(s.after[0], call, e)
            elif at < len(kinds) and (kinds[at] == s.value if s.kind == "tok" else kinds[at] not in self.never):
                add(s.after[0], call, at + 1)
        return root.ends

    def islands(self, kinds: list[str], rule: str, starts) -> list[tuple[int, int]]:
        """(first, behind the last) token of the shortest match at each of ``starts`` that has one."""
        return [(i, min(e)) for i in starts if (e := self.ends(kinds, rule, i))]

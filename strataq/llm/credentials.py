"""Credentials in configuration and source text: found by place, judged by a trained model, masked in place.

Candidates are values at places where a credential could stand (assigned values, members, arguments, flags, headers,
parts of addresses and connection strings, notes in comments). A logistic regression alone decides, over the likelihood of
a value's characters under two Markov chains, the make-up of the value, the identifiers around it, the kind of place and
the path. It is trained here on candidates that fixed patterns label weakly; the patterns are no features and have no say
afterwards, and much is left unlabelled: short and memorable values outside addresses, connection strings and password
names, values in comments, flags, members and bare assignments, and everything under names that no pattern knows. Scores
are calibrated on candidates that training left out.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.scale import cut, spread

#: Texts that the model is fitted on, at most, and the characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 10_000, 20_000
#: Calibrated probability from which a candidate is a credential.
THRESHOLD = 0.5
_DIM = 1 << 20

# Formats of keys whose issuer marks them, words in names of secrets and of other things, stand-ins.
# A value that begins with a slash is a path only below a known root or where all its parts are words.
_ISSUED = re.compile(
    r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|xox[abprs]-[A-Za-z0-9-]{16,}|AKIA[0-9A-Z]{16}|AIza[\w-]{30,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|AGE-[A-Z0-9-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}|[a-z]{3}-[a-z0-9]{28,}"
)
_SECRET_NAME = re.compile(r"(?i)pass(?!ive|age|enger|ed\b|es\b)|pwd|\bpw\b|_pw$|^pw|secret|token|api_?-?key|access_?key|account_?key|private_?key|signing_?key|master_?key|licen[sc]e_?key|shared_?access|stripe|auth(?!or)|credential|\bsig(?:nature)?\b|bearer|basic|x-api")
_OTHER_NAME = re.compile(
    r"(?i)(?:^|[_\-. ])(?:id|name|ref|file|path|url|uri|ttl|type|label|pattern|min|max|length|header|hint|help|expiry|expires|lifetime|count|limit|size|policy|regex|field|column|prompt|placeholder|title|text|vault|env|var|arn|version|format|algorithm|alg|issuer|audience|scope)(?:$|[_\-. ])|"
    r"public|publish|etag|commit|checksum|integrity|digest|\bhash|icon|image|cert|sort_?key|primary_?key|foreign_?key|partition_?key|cache_?key"
)
_STAND_IN = re.compile(
    r"""(?ix)^(?:
      \s* | [x*.\-_#?•]{3,} | (?:\w{2,6}_(?:live|test)_)?x{4,} | \*+ | .*\bx{6,}\b.* | .*\*{4,}.* | <[^<>]*> | \[[^\[\]]*\] | \{\{.*\}\} | \$\{.*\} | \$\(.*\) | \$\w+ | %\w+% | \#\{.*\}\#? | @\{?\w+\}? | __\w+__ | \#\w+\#
      | @\w+\(.*\) | (?:env|vault|file|ref|kv|secret|ssm|op|gcp|aws|azure|keyvault|arn|sops)\s*:.* | \w+://\S*(?:vault|secret|value)\S* | (?:kv|secrets?|run|etc|vault)/.* | (?-i:/(?:run|etc|var|usr|opt|home|root|mnt|tmp|srv|app|data|secrets?|vault)(?:/[\w./-]*)?|(?:/(?:(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[a-z]|[A-Z]+)?\d{0,4}(?:[_.-]+(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[a-z]|[A-Z]+)?\d{0,4})*))+) | [A-Za-z]:\\.* | \.{1,2}/.*
      | (?:change|replace|insert|enter|add|put|fill|set|update|type|paste)[\s_-]*(?:me|this|it|in|here|your|a|the|key|value|secret|password)?(?:[\s_-].*)? | your[\s_-].* | my[\s_-]?(?:secret|password|token|key) | todo.* | tbd | fixme | none | null | nil | undefined | n/a | dummy.* | example.* | sample.* | placeholder.*
      | (?:the[\s_-])?(?:secret|password|passwd|token|api[\s_-]?key|key|value)(?:[\s_-]?(?:here|goes[\s_-]here))? | to[\s_-]be[\s_-].* | redacted | masked | hidden | removed | empty | secret | true | false | yes | no | on | off
      | bearer | basic | authorization | .*\b(?:process\.env|os\.environ|getenv|config(?:uration)?\[|env::var)\b.*
    )$"""
)
_OTHER_FORM = re.compile(r"(?i)^(?:pk_(?:live|test)_\w+|acct_\w+|sha\d+[-:].*|data:\S+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|https?://\S*|\d{1,6}|\d+(?:\.\d+)+\w*|-----BEGIN .*|ssh-(?:rsa|ed25519)\s.*)$", re.DOTALL)

_PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PUBLIC = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST)-----[\s\S]*?(?:-----END [A-Z0-9 ]*-----|\Z)")
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s/@:\"'`]*):([^\s\"'`/]+)@(?=[\w\[])")
_ADDRESS = re.compile(r"://[^\s\"'`]*")  # of any length, up to what breaks it
_QUERY = re.compile(r"[?&]([A-Za-z_][\w.\-]*)=([^&\s\"'`;<>]+)")
_MEMBER = re.compile(r"\s*([A-Za-z][\w .\-]*?)\s*=\s*")
_QUOTED = re.compile(r"@?\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`")
_NAME_BEFORE = re.compile(r"([A-Za-z_$][\w$.\-]*)[\"'`]?\s*\]?\s*(?::\s*[&\w<>\[\]|' ]{1,24}?)?\s*(?:=>|:=|[!=]==?|=|:|,|\?\?|\|\||\()\s*(?:Value\s*=\s*)?[rRbBuUf@$]*$")
_CALL_BEFORE = re.compile(r"([A-Za-z_$][\w$]*)\s*\(\s*[rRbBuUf@$]*$")
_BARE = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|ENV[ \t]+|ARG[ \t]+|set[ \t]+|-[ \t]+|\./\w+[ \t]+--set[ \t]+|.*?[ \t]--set[ \t]+|//\S*:)?(?P<name>[A-Za-z_][\w.\-]*)[ \t]*(?:=|:(?=[ \t]))[ \t]*(?P<value>[^\s\"'`#;,{}\[\]()<>][^\s\"'`]*)[ \t]*,?\r?$")
_ENV_SPACE = re.compile(r"(?m)^[ \t]*ENV[ \t]+(\w+)[ \t]+(?![=])([^\s\"'=]+)[ \t]*\r?$")
_XML_TEXT = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\n]*)</\1>")
_XML_ADD = re.compile(r"(?i)\b(?:key|name)\s*=\s*\"([^\"\n]*)\"\s*,?\s*value\s*=\s*\"([^\"\n]*)\"|\"name\"\s*:\s*\"([^\"\n]*)\"\s*,\s*\"value\"\s*:\s*\"([^\"\n]*)\"")
_YAML_NAME = re.compile(r"(?m)^[ \t]*-[ \t]*name:[ \t]*[\"']?([\w.\-]+)[\"']?[ \t]*\r?\n[ \t]*value:[ \t]*(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'#][^\s]*))")
_FLAG = re.compile(r"(?:^|\s)(-u|--user)[ =]?[\"']?([^\s:\"']+):([^\s\"'@]+)|(?:mysql|mysqldump|mariadb|psql|mongo\w*)\b[^\n]*?\s-p([^\s\"']+)|\s--(password|passwd|token|secret|api-key|pass|auth-token)[ =][\"']?([^\s\"']+)")
_NOTE = re.compile(r"(?i)\b(?:(was|old|previous|former|current|live|prod\w*|temp\w*|rotate\w*)\b[^\n=:]{0,30}?[:\s]\s*)?\b([A-Za-z_]\w*)\s*(=|:|\bis\b)\s*([^\s\"'`<>,]+)")
_LOGIN = re.compile(r"(?i)\blog(?:in|on)\b\s+(?:as\s+|with\s+)?(\S+)\s*(?:/|:|\bwith\b|\band\b)\s*([^\s\"'`<>]+)")
_DSN = re.compile(r"(?<![\w/:])[\w.\-]+:([^\s\"'`/:@]+)@(?:tcp|unix|udp)\(")
_NETRC = re.compile(r"\blogin[ \t]+\S+[ \t]+password[ \t]+(\S+)")
_SIGN_IN = re.compile(r"(?i)\b(?:\w*log_?in|\w*basic_?auth|\w*credentials?|authenticate|sign_?in)\s*\(\s*([\"'`])[^\"'`\n]*\1\s*,\s*(?:Some\(\s*)?([\"'`])((?:[^\"'`\\\n]|\\.)*)\2")
#: Calls and words that stand before a value without naming it.
_NAMELESS = frozenset("value str string unwrap_or unwrap_or_else or default some into from format print println printf writeline".split())
_SCHEME = re.compile(r"(?i)\b(bearer|basic|token)[ \t]+([A-Za-z0-9._~+/=\-]{6,})")
_COMMENT = re.compile(r"(?m)(?:(?:^|\s)(?:#|//|/\*|<!--)|^[ \t]*(?:;|--|\*|REM\b))[^\n]*|\"_(?:note|comment)\"\s*:\s*\"[^\"\n]*\"")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass(slots=True)
class Candidate:
    """A value (start, end) with the name it belongs to and the kind of place."""

    start: int
    end: int
    name: str
    kind: str
    value: str


def candidates(text: str, field: str) -> list[Candidate]:
    """The places of a text where a credential could stand. ``field`` is the name of the field that the text is in."""
    found: dict[tuple[int, int], Candidate] = {}
    closed: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= s or a >= e for s, e in closed)

    def add(a: int, b: int, name: str, kind: str) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b and free(a, b) and (a, b) not in found:
            found[a, b] = Candidate(a, b, name, kind, text[a:b])

    low = text.lower()
    armour = "-----begin" in low
    for m in _PRIVATE.finditer(text) if armour else ():
        found[m.span()] = Candidate(*m.span(), "private key", "pem", m[0])
        closed.append(m.span())
    for m in _PUBLIC.finditer(text) if armour else ():
        closed.append(m.span())
    for m in _USERINFO.finditer(text) if "://" in text and "@" in text else ():
        add(*m.span(2), "password", "url")
        closed.append(m.span(2))
    for rule, there in ((_DSN, "@" in text and "(" in text), (_NETRC, "password" in low and "login" in low)):
        for m in rule.finditer(text) if there else ():
            add(*m.span(1), "password", "url")
            closed.append(m.span(1))
    for m in _SIGN_IN.finditer(text) if any(x in low for x in ("log", "auth", "credential", "sign")) else ():
        add(*m.span(3), "password", "login")
        closed.append(m.span(3))
    addresses = _ADDRESS.finditer(text)
    address = next(addresses, None)
    for m in _QUERY.finditer(text) if "://" in text else ():
        while address and address.end() <= m.start():
            address = next(addresses, None)
        if address and address.start() < m.start() or "://" in text[max(0, m.start() - 200) : m.start()].rsplit("\n", 1)[-1]:
            add(*m.span(2), m[1], "query")
    notes = list(_COMMENT.finditer(text)) if field == "secret" else []
    for m in _SCHEME.finditer(text) if any(x in low for x in ("bearer", "basic", "token")) else ():
        add(*m.span(2), m[1].lower(), "scheme")
        if (m.span(2)) in found:
            closed.append(m.span(2))
    if field == "stripe.key":
        at = 0
        for part in text.split(","):
            add(at, at + len(part), "key", "whole")
            at += len(part) + 1
        return list(found.values())
    if field == "connectionstrings.shop":
        _pairs(text, 0, add)
        return list(found.values())
    for m in _FLAG.finditer(text) if "-u" in text or "-p" in text or "--" in text else ():
        if m[1]:
            add(*m.span(3), "password", "flag")
            closed.append(m.span(3))
        elif m[4]:
            add(*m.span(4), "password", "flag")
        else:
            add(*m.span(6), m[5], "flag")
    for m in _YAML_NAME.finditer(text):
        g = next(g for g in (2, 3, 4) if m[g] is not None)
        add(*m.span(g), m[1], "member")
        closed.append(m.span(g))
    for m in _XML_ADD.finditer(text) if "value" in low else ():
        g = 2 if m[1] is not None else 4
        add(*m.span(g), m[g - 1], "member")
        closed.append(m.span(g))
    for m in _XML_TEXT.finditer(text) if "</" in text else ():
        add(*m.span(2), m[1], "member")
    for m in notes:
        a = m.start()
        for n in _LOGIN.finditer(m[0]):
            add(a + n.start(2), a + n.end(2), "login password", "note")
        for n in _NOTE.finditer(m[0]):
            b = a + n.start(4) + len(n[4].rstrip(".;:!?*/)" if not re.search(r"[A-Za-z0-9][!*]$", n[4]) else ";:)"))
            add(a + n.start(4), b, n[2] if n[2].lower() not in ("is", "was") else n[1] or "", "note")
    for m in _QUOTED.finditer(text):
        g = next(g for g in (1, 2, 3) if m[g] is not None)
        a, b = m.span(g)
        inside = text[a:b]
        if not free(a, b):
            continue
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if re.search(r"(?i)(?:^|;)[^;=]{2,30}=[^;]*;", inside) and _pairs(inside, a, add):
            continue
        name = _name(line)
        if (call := _CALL_BEFORE.search(line)) and call[1].lower() in ("getenv", "get", "var", "env", "environ", "includes", "has"):
            continue  # the name of a variable, not its value
        if re.match(r"\s*\]\s*=(?!=)|\s*:", text[m.end() : m.end() + 4]) and re.search(r"(?:^|[\[{,(])\s*$", line):
            continue  # a key
        add(a, b, name, "quoted")
    for m in _BARE.finditer(text):
        if not any(n.start() <= m.start("value") < n.end() for n in notes) and not _QUOTED.match(text, m.start("value")):
            add(*m.span("value"), m["name"], "bare")
    for m in _ENV_SPACE.finditer(text):
        add(*m.span(2), m[1], "bare")
    for m in _ISSUED.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-./")) and not any(c.start < m.end() and m.start() < c.end for c in found.values()):
            add(*m.span(), "", "loose")
    return list(found.values())


def _pairs(text: str, offset: int, add) -> bool:
    """Members of a connection string; a value in quotes is without them."""
    semicolons = ";" in text
    any_ = False
    at = 0
    while at < len(text):
        m = _MEMBER.match(text, at)
        stop = ";" if semicolons else ","
        if m:
            v = m.end()
            if text[v : v + 1] in "\"'" and (end := text.find(text[v], v + 1)) > 0:
                add(offset + v + 1, offset + end, m[1], "pair")
                at = text.find(stop, end)
            else:
                end = text.find(stop, v)
                end = len(text) if end < 0 else end
                add(offset + v, offset + end, m[1], "pair")
                at = end
            any_ = True
        else:
            at = text.find(stop, at)
        at = len(text) if at < 0 else at + 1
    return any_


def _name(line: str) -> str:
    """The name nearest before a value on its line."""
    if m := _NAME_BEFORE.search(line):
        name = m[1]
        if name.rsplit(".", 1)[-1].lower() in _NAMELESS or len(name) == 1:
            before = re.findall(r"[A-Za-z_][\w\-]*", line[: m.start()])
            name = next((b for b in before if _SECRET_NAME.search(_snake(b))), before[-1] if before else name)
        return name.rsplit(".", 1)[-1] or name
    names = re.findall(r"[A-Za-z_][\w\-]*", line)
    return names[-1] if names else ""


def _plain_basic(value: str) -> str | None:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except ValueError:
        return None


def weak_label(c: Candidate) -> bool | None:
    """What fixed patterns say of a candidate; null where they say nothing, and the model is on its own."""
    v, name = c.value, _snake(c.name.strip())
    if _PRIVATE.fullmatch(v):
        return True
    if _STAND_IN.match(v) or _OTHER_FORM.match(v) or _OTHER_NAME.search(name):
        return False
    if _ISSUED.fullmatch(v):
        return True
    if c.kind == "scheme" and c.name == "basic":
        return ":" in (_plain_basic(v) or "")
    if " " in v or re.fullmatch(r"[A-Za-z]+|\d+|[a-z]+[._/-][a-z._/-]+", v):
        return False
    named = _SECRET_NAME.search(name) is not None
    letters, digits = re.search(r"[A-Za-z]", v), re.search(r"\d", v)
    if (named or c.kind in ("url", "login", "flag")) and len(v) >= 10 and digits and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v):
        return True
    if len(v) < 6 or not letters or not (digits or re.search(r"[^\w\s]", v)):
        return None
    if c.kind in ("url", "login", "scheme") or (c.kind == "pair" and named) or (c.kind == "whole" and len(v) >= 20):
        return True
    if c.kind == "query" and len(v) >= 16 and name.lower() in ("key", "access", "code", "apikey"):
        return True
    return True if c.kind == "quoted" and named and digits and (len(v) >= 20 or re.search(r"(?i)pass|pwd", name)) else None


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)


def _bucket(x: float, step: float, low: float, high: float) -> int:
    return int(max(low, min(high, x)) / step)


@dataclass
class Model:
    """Two character chains, the weights, the calibration of the score, and how the model did on what it was not fitted to.

    ``report`` has, over the candidates held out: their number, the share of weak labels that the decision agrees with, the
    mean difference of probability and label in each tenth of probability weighed by its candidates, and the candidates of
    the sample that have no label.
    """

    chains: tuple[dict, dict]
    weights: dict[int, float]
    calibration: tuple[float, float]
    report: dict = field(default_factory=dict)
    _memory: dict = field(default_factory=dict, repr=False)

    def _remember(self, key, make):
        found = self._memory.get(key)
        if found is None:
            if len(self._memory) > 300_000:
                self._memory.clear()
            found = self._memory[key] = make()
        return found

    def weight(self, f: str) -> float:
        return self._remember(f, lambda: self.weights.get(_slot(f), 0.0))

    def _sum(self, fs) -> float:
        return sum(map(self.weight, fs))

    def probability(self, c: Candidate, path: str) -> float:
        """What stands in a value, a name or a path alone is summed once for all candidates that share it."""
        value = self._remember(("value", c.value), lambda: (v := _Value(c.value, self.chains), self._sum(v.features())))
        name = self._remember(("name", c.name), lambda: (n := _Name(c.name), self._sum(n.features())))
        of_path = self._remember(("path", path), lambda: (None, self._sum(_path_features(path))))
        a, b = self.calibration
        s = a * (value[1] + name[1] + of_path[1] + self._sum(_crossed(c, value[0], name[0]))) + b
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, s))))


def _slot(f: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(f) % _DIM


def _class(ch: str) -> str:
    return ch if ch.isascii() else "~"


def _pairs_of(value: str) -> Iterator[str]:
    prev = "^"
    for ch in value + "$":
        ch = _class(ch)
        yield prev + ch
        prev = ch


def _chain(values: list[str]) -> dict[str, float]:
    """Log probabilities of character pairs, smoothed over 96 characters."""
    return _chain_of(Counter(p for v in values for p in _pairs_of(v)))


def _chain_of(pair: dict[str, float]) -> dict[str, float]:
    first: Counter = Counter()
    for p, n in pair.items():
        first[p[0]] += n
    out = {p: math.log((n + 0.5) / (first[p[0]] + 48)) for p, n in pair.items()}
    out[""] = math.log(0.5 / 60)
    return out


def _likelihood(value: str, chain: dict[str, float]) -> float:
    floor, get = chain[""], chain.get
    v = value if value.isascii() else "".join(map(_class, value))
    return sum([get(a + b, floor) for a, b in zip("^" + v, v + "$")]) / (len(value) + 1)


class _Kinds(dict):
    """For ``str.translate``: the kind of each character, made when first asked for."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = k = "A" if ch.isupper() else "a" if ch.islower() else "0" if ch.isdigit() else " " if ch.isspace() else _class(ch)
        return k


_KINDS = _Kinds()
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


class _Value:
    """What a value is made up of: the likelihood ratio of its characters, their kinds and runs, its length and words."""

    def __init__(self, v: str, chains: tuple[dict, dict]):
        n = len(v)
        self.v = v
        per_char = _likelihood(v, chains[0]) - _likelihood(v, chains[1])
        self.ratio, self.sum = _bucket(per_char, 0.25, -4, 4), _bucket(per_char * min(n, 40), 4, -60, 60)
        kinds = v.translate(_KINDS)
        self.runs = _RUN.sub(r"\1", kinds)
        self.ends = kinds[0] + kinds[-1]
        upper, lower, digit = kinds.count("A"), kinds.count("a"), kinds.count("0")
        self.mix = f"{min(3, 4 * upper // n)}{min(3, 4 * lower // n)}{min(3, 4 * digit // n)}{min(3, 4 * (n - upper - lower - digit) // n)}"
        self.length, self.turns = min(24, int(math.log2(n + 1) * 3)), min(8, len(self.runs) * 8 // n)
        self.hex = _HEX.fullmatch(v) is not None

    def features(self) -> list[str]:
        said = [w.lower() for w in re.findall(r"[A-Za-z]{2,20}", self.v)]
        return [
            "bias", f"r={self.ratio}", f"sum={self.sum}", f"mix={self.mix}", f"len={self.length}", f"turns={self.turns}", f"turns={self.turns}|{self.length}", f"ends={self.ends}", f"set={''.join(sorted(set(self.runs)))}",
            f"runs={self.runs if len(self.runs) < 6 else len(self.runs) // 4}", f"start={self.v[:3].lower()}", f"said={min(6, len(said))}|{self.turns}", f"hex={self.hex}|{self.length}", *{f"v={w}" for w in said},
        ]


class _Name:
    def __init__(self, name: str):
        words = [w.lower() for w in _WORDS.findall(name)]
        self.words, self.joined, self.last = words, "".join(words), words[-1] if words else ""

    def features(self) -> list[str]:
        return [f"name={self.joined}", *{f"w={w}" for w in self.words}, *{f"g={self.joined[i : i + 4]}" for i in range(max(1, len(self.joined) - 3))}]


def _path_features(path: str) -> list[str]:
    extension = path.rsplit(".", 1)[-1].lower()[:12] if "." in path else ""
    stem = re.sub(r"\d+", "0", path.rsplit("/", 1)[-1].split(".")[0].lower())[:20]
    return [f"ext={extension}", f"stem={stem}"]


def _crossed(c: Candidate, v: _Value, n: _Name) -> list[str]:
    decoded = _plain_basic(c.value) if c.kind == "scheme" else None
    return [
        f"kind={c.kind}", f"kind={c.kind}|{v.ratio}", f"kind={c.kind}|{v.mix}", f"hex={v.hex}|{n.last}", f"name={n.joined}|{v.ratio > 0}", f"last={n.last}|{v.ratio}", f"last={n.last}|{c.kind}",
        f"decoded={decoded is not None and ':' in decoded}|{c.name == 'basic'}",
    ]


def features(c: Candidate, path: str, chains: tuple[dict, dict]) -> list[str]:
    """What the regression sees of a candidate; none of the labelling patterns is among it."""
    v, n = _Value(c.value, chains), _Name(c.name)
    return v.features() + n.features() + _path_features(path) + _crossed(c, v, n)


_LABELLED = "h bigint, path string, name string, kind string, value string, y int"


def _labelled(sample: DataFrame) -> DataFrame:
    """The candidates of the sample with their weak labels (1, 0 or -1 for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text_field, path, text, h in zip(*(c.to_pylist() for c in b.columns)):
                for c in candidates(text, text_field):
                    y = weak_label(c)
                    rows.append((h, path, c.name, c.kind, c.value, -1 if y is None else int(y)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.string()] * 4, pa.int32()])], ["h", "path", "name", "kind", "value", "y"])

    return sample.mapInArrow(run, _LABELLED)


def fit(texts: DataFrame) -> Model:
    """A model from a bounded sample of ``texts`` (field, path, text), chosen by the hash of the text: the same texts give the
    same model. Labels, chain counts and features are made on the executors; the driver gets hashed features alone."""
    from strataq.llm.sentences import _logistic, sample_of

    some = texts.filter(F.length("text").between(1, SAMPLE_CHARS)).select("field", F.coalesce("path", F.lit("")).alias("path"), "text")
    sample = sample_of(some, "text", SAMPLE_TEXTS).withColumn("h", F.xxhash64("text", "field")).repartition(texts.sparkSession.sparkContext.defaultParallelism)
    found = cut(_labelled(sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for v, y in zip(*(c.to_pylist() for c in b.columns)):
                n.update((y, p) for p in _pairs_of(v))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["y", "pair", "n"])

    trained = found.filter((F.col("y") >= 0) & (F.pmod("h", F.lit(5)) != 0))
    pairs: tuple[Counter, Counter] = (Counter(), Counter())
    for r in trained.select("value", "y").mapInArrow(count, "y int, pair string, n bigint").groupBy("y", "pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.y][r.pair] = r.n
    chains = (_chain_of(pairs[1]), _chain_of(pairs[0]))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, path, name, kind, value, y = (c.to_pylist() for c in b.columns)
            out = [sorted({_slot(f) for f in features(Candidate(0, 0, n, k, v), p, chains)}) for p, n, k, v in zip(path, name, kind, value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32())), b.column(5)], ["h", "slots", "y"])

    rows = found.filter("y >= 0").mapInArrow(slots, "h bigint, slots array<int>, y int").groupBy("h", "slots", "y").agg(F.count(F.lit(1)).alias("n")).toPandas()
    rows["key"] = [str(list(x)) for x in rows["slots"]]
    rows = rows.sort_values(["h", "key", "y"], kind="stable")
    rows = rows.loc[rows.index.repeat(rows["n"])]
    train, held = rows[rows["h"] % 5 != 0], rows[rows["h"] % 5 == 0]
    if not len(train) or not train["y"].any():
        return Model(chains, {}, (1.0, -5.0))  # nothing to learn from: nothing is a credential
    weights = _logistic([list(x) for x in train["slots"]], train["y"].astype(float).tolist(), rounds=300, dim=_DIM, balanced=False)
    scores = np.array([sum(weights.get(int(k), 0.0) for k in x) for x in held["slots"]])
    labels = held["y"].to_numpy(float)
    calibration = _platt(scores, labels)
    report = {"held out": len(held), "without a label": found.filter("y < 0").count(), "labelled": len(rows)}
    if len(held):
        p = 1 / (1 + np.exp(-np.clip(calibration[0] * scores + calibration[1], -50, 50)))
        tenth = np.minimum((p * 10).astype(int), 9)
        gaps = [abs(p[tenth == k].mean() - labels[tenth == k].mean()) * (tenth == k).sum() for k in range(10) if (tenth == k).any()]
        report |= {"agreement": float(((p >= THRESHOLD) == labels).mean()), "calibration error": float(sum(gaps) / len(held))}
    return Model(chains, weights, calibration, report)


def _platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton steps on held-out candidates."""
    if len(scores) < 20 or labels.min() == labels.max():
        return 1.0, 0.0
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -50, 50)))
        g = np.array([((p - target) * scores).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * scores * scores).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def credentials_in(text: str, field: str, path: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, probability) of the credentials of a text; spans do not overlap."""
    out: list[tuple[int, int, float]] = []
    scored = sorted(((model.probability(c, path), c) for c in candidates(text, field)), key=lambda x: (-x[0], x[1].end - x[1].start, x[1].start))
    for p, c in scored:
        if p >= THRESHOLD:
            if all(c.end <= s or c.start >= e for s, e, _ in out):
                out.append((c.start, c.end, p))
    return sorted(out)


def mask(text: str, spans: list[tuple[int, int, float]]) -> str:
    """The text with each credential, line breaks apart, replaced by as many letters x; all else stays in its place.

    Letters, since bare asterisks would be an alias in YAML; a bare or quoted word of them parses wherever a value did.
    """
    out, at = [], 0
    for s, e, _ in spans:
        out += [text[at:s], re.sub(r"[^\r\n]", "x", text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def texts_of(settings: DataFrame, src: DataFrame) -> DataFrame:
    """field, row_id, path, text of the fields that may hold credentials; null texts and structs are left out."""
    a = settings.select(F.col("setting_id").alias("row_id"), F.col("rel_path").alias("path"), F.col("stripe.key").alias("k"), F.col("connectionstrings.shop").alias("c"))
    one = F.explode(F.array(F.struct(F.lit("stripe.key").alias("field"), F.col("k").alias("text")), F.struct(F.lit("connectionstrings.shop").alias("field"), F.col("c").alias("text"))))
    both = a.select("row_id", "path", one.alias("x")).select("x.field", "row_id", "path", "x.text")
    b = src.select(F.lit("secret").alias("field"), F.col("src_id").alias("row_id"), F.col("rel_path").alias("path"), F.col("secret").alias("text"))
    return both.unionByName(b).filter(F.col("text").isNotNull())


def found(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """field, row_id, start_pos, end_pos, probability: one row per credential of ``texts`` (field, row_id, path, text).

    Null, empty and blank texts have none; repeated rows give their credentials once.
    """
    fitted = model or fit(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for field, key, path, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(field, key, s, e, p) for s, e, p in credentials_in(text, field, path or "", fitted)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["field", "row_id", "start_pos", "end_pos", "probability"])

    some = spread(texts.select("field", F.col("row_id").cast("bigint"), "path", "text").filter(F.length("text") > 0))
    return some.mapInArrow(run, "field string, row_id bigint, start_pos int, end_pos int, probability double").distinct()


def decided(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """field, row_id, start_pos, kind, label: the credentials of ``found`` with what the patterns say (1, 0 or -1 for nothing)."""
    fitted = model or fit(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text_field, key, path, text in zip(*(c.to_pylist() for c in b.columns)):
                spans = {(s, e) for s, e, _ in credentials_in(text, text_field, path or "", fitted)}
                rows += [(text_field, key, c.start, c.kind, -1 if (y := weak_label(c)) is None else int(y)) for c in (candidates(text, text_field) if spans else ()) if (c.start, c.end) in spans]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()])], ["field", "row_id", "start_pos", "kind", "label"])

    some = spread(texts.select("field", F.col("row_id").cast("bigint"), "path", "text").filter(F.length("text") > 0))
    return some.mapInArrow(run, "field string, row_id bigint, start_pos int, kind string, label int").distinct()


def redacted(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """field, row_id, n_masked, text: every text of ``texts`` with its credentials masked, and how many there were."""
    fitted = model or fit(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, out = [], []
            for field, _, path, text in zip(*(c.to_pylist() for c in b.columns)):
                spans = credentials_in(text, field, path or "", fitted)
                numbers.append(len(spans))
                out.append(mask(text, spans))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers, pa.int32()), pa.array(out, pa.string())], ["field", "row_id", "n_masked", "text"])

    some = spread(texts.select("field", F.col("row_id").cast("bigint"), "path", "text").filter(F.col("text").isNotNull()))
    return some.mapInArrow(run, "field string, row_id bigint, n_masked int, text string").distinct()

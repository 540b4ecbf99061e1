"""Tokens of six programming languages, as kinds for grammars: literals and keywords stand for themselves.

What no rule covers (an unterminated string, a stray character) becomes the kind ERR, which no grammar has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    new_line: bool = False  # the first of its line


# The reserved words of each language.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield null true false async of static get set from",
    "typescript": "",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " interface enum implements private public protected readonly abstract declare namespace type as satisfies keyof is infer"
_WORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

# Operators, the longest first.
_OPERATORS = {
    "python": "**= //= >>= <<= ... != == -> := += -= *= /= %= &= |= ^= @= ** // << >> <= >= ( ) [ ] { } , : ; . = + - * / % & | ^ ~ < > @ !",
    "javascript": ">>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** ( ) [ ] { } , : ; . = + - * / % & | ^ ~ < > ! ? @ #",
    "go": "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ ( ) [ ] { } , : ; . = + - * / % & | ^ ~ < > !",
    "csharp": "<<= >>= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= -> :: .. << ( ) [ ] { } , : ; . = + - * / % & | ^ ~ < > ! ? #",
    "rust": "<<= >>= ..= ... => -> == != <= >= && || += -= *= /= %= &= |= ^= :: .. << ( ) [ ] { } , : ; . = + - * / % & | ^ < > ! ? @ # $ ~",
}
_OPERATORS["typescript"] = _OPERATORS["javascript"]
_OP = {k: re.compile("|".join(re.escape(o) for o in v.split())) for k, v in _OPERATORS.items()}

_SPACE = re.compile(r"[ \t\f\v\r ﻿]+|\\\r?\n")
_ID = re.compile(r"[^\W\d][\w]*")
_ID_JS = re.compile(r"(?:[^\W\d]|\$)[\w$]*")
_NUM = re.compile(r"0[xX][0-9a-fA-F_]+\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|(?:\d[\d_]*\.(?![.\w])|\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?(\w*)")
_SUFFIX = {
    "python": r"[jJ]?", "javascript": r"n?", "typescript": r"n?", "go": r"i?", "csharp": r"(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])", "rust": r"_?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?",
}
_LINE_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\r\n]|\\(?:\r\n|[\s\S]))*{q}") for q in "'\""}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-zA-Z]*")
_RUST_RAW = re.compile(r'(?:b|c)?r(#*)"')
_RUST_CHAR = re.compile(r"b?'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'")
_LIFETIME = re.compile(r"'[^\W\d]\w*(?!')")
_RUST_STRING = re.compile(r'[bc]?"(?:[^"\\]|\\[\s\S])*"')
_CS_CHAR = re.compile(r"'(?:[^'\\\r\n]|\\(?:[xuU][0-9a-fA-F]+|.))'")
_CS_RAW = re.compile(r'\$*("{3,})')
_CS_VERBATIM = re.compile(r'@"(?:[^"]|"")*"')
_GO_CHAR = re.compile(r"'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'")
_PY_STRING = re.compile(r"(?i:[rbu]|br|rb|f|fr|rf|t)?(?:'''|\"\"\"|'|\")")
_BEFORE_VALUE = frozenset("( [ { , ; : = => ! ? & && | || ?? + - * / % ^ ~ < > <= >= == != === !== += -= *= /= return typeof case in of instanceof new delete void throw else do await yield ${".split()) | {"}", None}


#: Languages in which an element of markup is a value.
DIALECTS = {"jsx": "javascript", "tsx": "typescript"}
_TAG_NAME = re.compile(r"[^\W\d][\w.:-]*")
_TAG_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")
_TAG_VALUE = re.compile(r"\s*=\s*")

_AFTER_NUMBER = frozenset("and else for if in is not or".split())


class _Lexer:
    def __init__(self, text: str, language: str):
        self.jsx = language in DIALECTS
        language = DIALECTS.get(language, language)
        self.s, self.lang = text, language
        self.out: list[Token] = []
        self.words, self.op = _WORDS[language], _OP[language]
        self.id = _ID_JS if language in ("javascript", "typescript") else _ID
        self.line = True
        self.suffix = re.compile(_SUFFIX[language])

    def add(self, kind: str, start: int, end: int) -> int:
        self.out.append(Token(kind, start, end, self.line))
        self.line = False
        return end

    def run(self, at: int, stop: str | None = None) -> int:
        """Lex from ``at`` to the end, or within an interpolation to the bracket that closes it."""
        s, n, lang = self.s, len(self.s), self.lang
        depth = 0
        while at < n:
            c = s[at]
            if c == "\n":
                self.line = True
                at += 1
                continue
            if m := _SPACE.match(s, at):
                if m[0][0] == "\\" and lang not in ("python",):
                    at = self.add("ERR", at, m.end())
                else:
                    at = m.end()
                continue
            if (end := self.comment(at)) is not None:
                if end < 0:
                    return self.add("ERR", at, n)
                if "\n" in s[at:end]:
                    self.line = True
                at = end
                continue
            if (end := self.string(at)) is not None:
                at = end
                continue
            if c.isdigit() or (c == "." and at + 1 < n and s[at + 1].isdigit()):
                m = _NUM.match(s, at)
                tail = m[1] or ""
                if lang == "python" and tail.lstrip("jJ") in _AFTER_NUMBER:  # a word may follow without a space
                    at = self.add("NUM", at, m.end() - len(tail.lstrip("jJ")))
                    continue
                at = self.add("NUM" if self.suffix.fullmatch(tail) else "ERR", at, m.end())
                continue
            if m := self.id.match(s, at):
                w = m[0]
                at = self.add(w if w in self.words else "ID", at, m.end())
                continue
            if stop is not None and depth == 0 and (c == stop or (lang in ("python", "csharp") and c == ":" and s[at + 1 : at + 2] != ":") or (lang == "python" and c == "!" and s[at + 1 : at + 2] != "=")):
                return at
            if m := self.op.match(s, at):
                o = m[0]
                if o in "([{":
                    depth += 1
                elif o in ")]}":
                    depth -= 1
                    if stop is not None and depth < 0:
                        return at
                at = self.add(o, at, m.end())
                continue
            at = self.add("ERR", at, at + 1)
        return at

    def comment(self, at: int) -> int | None:
        """The end of a comment here; -1 if it does not end."""
        s = self.s
        if self.lang == "python":
            if s[at] != "#":
                return None
        elif s.startswith("/*", at):
            if self.lang != "rust":
                end = s.find("*/", at + 2)
                return end + 2 if end >= 0 else -1
            depth, k = 1, at + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(s, k)
                if not m:
                    return -1
                depth += 1 if m[0] == "/*" else -1
                k = m.end()
            return k
        elif not s.startswith("//", at) and not (s.startswith("#!", at) and at == 0) and not (self.lang == "csharp" and s[at] == "#" and self.line and s[at : at + 2] != "#("):
            return None
        end = s.find("\n", at)
        return len(s) if end < 0 else end

    def string(self, at: int) -> int | None:
        s, c, lang = self.s, self.s[at], self.lang
        if lang == "python":
            m = _PY_STRING.match(s, at)
            return self.python_string(at, m) if m else None
        if lang in ("javascript", "typescript"):
            if c in "'\"":
                m = _LINE_STRING[c].match(s, at)
                return self.add("STR", at, m.end()) if m else self.bad(at)
            if c == "`":
                return self.parts(at, at + 1, "`", "${", "\\")
            if c == "<" and self.jsx and (self.out[-1].kind if self.out else None) in _BEFORE_VALUE and s[at + 1 : at + 2] != "<":
                self.add("SB", at, at + 1)
                end = self.element(at)
                return self.add("SE", end - 1, end) if end >= 0 else self.add("ERR", at, len(s))
            if c == "/" and (self.out[-1].kind if self.out else None) in _BEFORE_VALUE:
                if m := _REGEX.match(s, at):
                    return self.add("REGEX", at, m.end())
            return None
        if lang == "go":
            if c == "`":
                end = s.find("`", at + 1)
                return self.add("STR", at, end + 1) if end >= 0 else self.add("ERR", at, len(s))
            if c == '"':
                m = _LINE_STRING[c].match(s, at)
                return self.add("STR", at, m.end()) if m and "\n" not in m[0] else self.bad(at)
            if c == "'":
                m = _GO_CHAR.match(s, at)
                return self.add("CHAR", at, m.end()) if m else self.bad(at)
            return None
        if lang == "rust":
            if m := _RUST_RAW.match(s, at):
                end = s.find('"' + m[1], m.end())
                return self.add("STR", at, end + 1 + len(m[1])) if end >= 0 else self.add("ERR", at, len(s))
            if m := _RUST_STRING.match(s, at):
                return self.add("STR", at, m.end())
            if c == '"':
                return self.add("ERR", at, len(s))
            if m := _RUST_CHAR.match(s, at):
                return self.add("CHAR", at, m.end())
            if m := _LIFETIME.match(s, at):
                return self.add("LIFE", at, m.end())
            return self.bad(at) if c == "'" else None
        # C#
        if m := _CS_RAW.match(s, at):
            end = s.find(m[1], m.end())
            while end >= 0 and s[end + len(m[1]) : end + len(m[1]) + 1] == '"':
                end += 1
            return self.add("STR", at, end + len(m[1])) if end >= 0 else self.add("ERR", at, len(s))
        if s.startswith(('$@"', '@$"'), at):
            return self.parts(at, at + 3, '"', "{", '"')
        if s.startswith('$"', at):
            return self.parts(at, at + 2, '"', "{", "\\")
        if s.startswith('@"', at):
            m = _CS_VERBATIM.match(s, at)
            return self.add("STR", at, m.end()) if m else self.add("ERR", at, len(s))
        if c == "@" and (m := _ID.match(s, at + 1)):
            return self.add("ID", at, m.end())
        if c == '"':
            m = _LINE_STRING[c].match(s, at)
            return self.add("STR", at, m.end()) if m and "\n" not in m[0] else self.bad(at)
        if c == "'":
            m = _CS_CHAR.match(s, at)
            return self.add("CHAR", at, m.end()) if m else self.bad(at)
        return None

    def hole(self, at: int) -> int:
        """What stands between braces within markup, as in a string with holes; the place behind it, or -1."""
        s = self.s
        k = _TAG_SPACE.match(s, at + 1).end()
        if s[k : k + 1] == "}":
            return k + 1  # nothing, or a comment
        self.add("${", at, at + 1)
        k = self.run(k + 3 if s.startswith("...", k) else k, "}")
        if s[k : k + 1] != "}":
            return -1
        return self.add("}$", k, k + 1)

    def element(self, at: int) -> int:
        """The place behind the element of markup that begins here, or -1 if it does not close; its holes become tokens."""
        s, n = self.s, len(self.s)
        open_: list[str] = []
        k = at
        while True:
            closing = s.startswith("</", k)
            k = _TAG_SPACE.match(s, k + (2 if closing else 1)).end()
            m = _TAG_NAME.match(s, k)
            name = m[0] if m else ""
            k = _TAG_SPACE.match(s, m.end() if m else k).end()
            if closing:
                if s[k : k + 1] != ">" or not open_ or open_.pop() != name:
                    return -1
                k += 1
            else:
                while k < n and s[k] not in "/>":
                    if s[k] == "{":
                        k = self.hole(k)
                    elif name and (a := _TAG_NAME.match(s, k)):
                        k = a.end()
                        if v := _TAG_VALUE.match(s, k):
                            k = v.end()
                            if s[k : k + 1] in ("'", '"'):
                                k = s.find(s[k], k + 1) + 1 or -1
                            elif s[k : k + 1] == "{":
                                k = self.hole(k)
                            else:
                                return -1
                    else:
                        return -1
                    if k < 0:
                        return -1
                    k = _TAG_SPACE.match(s, k).end()
                if s.startswith("/>", k) and name:
                    k += 2
                elif s[k : k + 1] == ">":
                    open_.append(name)
                    k += 1
                else:
                    return -1
            while open_ and k < n and s[k] != "<":
                if s[k] == "{":
                    k = self.hole(k)
                    if k < 0:
                        return -1
                elif s[k] in ">}":
                    return -1
                else:
                    k += 1
            if not open_:
                return k
            if k >= n:
                return -1

    def bad(self, at: int) -> int:
        end = self.s.find("\n", at)
        return self.add("ERR", at, len(self.s) if end < 0 else end)

    def python_string(self, at: int, m: re.Match) -> int:
        s = self.s
        quote = m[0].lstrip("rRbBuUfFtT")
        prefix = m[0][: -len(quote)].lower()
        if "f" in prefix or "t" in prefix:
            return self.parts(at, m.end(), quote, "{", "" if "r" in prefix else "\\")
        body = re.compile(rf"(?:(?!{quote})(?:\\[\s\S]|[^\\{'' if len(quote) == 3 else chr(92) + 'n'}]))*{quote}")
        end = body.match(s, m.end())
        if end:
            return self.add("STR", at, end.end())
        return self.add("ERR", at, len(s)) if len(quote) == 3 else self.bad(at)

    def parts(self, at: int, k: int, quote: str, hole: str, escape: str) -> int:
        """A string with holes: SB, then for each hole its bracket, what stands in it, and the closing one, then SE."""
        s, n = self.s, len(self.s)
        doubled = hole == "{"
        many = quote == "`" or len(quote) == 3 or escape == '"'
        self.add("SB", at, k)
        while k < n:
            c = s[k]
            if escape == "\\" and c == "\\":
                k += 2
            elif escape == '"' and s.startswith('""', k):
                k += 2
            elif s.startswith(quote, k):
                return self.add("SE", k, k + len(quote))
            elif c == "\n" and not many:
                return self.add("ERR", at, k)
            elif doubled and (s.startswith("{{", k) or s.startswith("}}", k)):
                k += 2
            elif s.startswith(hole, k):
                self.add("${", k, k + len(hole))
                k = self.run(k + len(hole), "}")
                if self.lang == "python" and k < n and s[k] == "!" and (m := re.compile(r"![rsa]").match(s, k)):
                    k = m.end()
                if k < n and s[k] == ":" and doubled:  # a format: any text, itself with holes
                    depth = 0
                    while k < n and not (s[k] == "}" and depth == 0) and (many or depth or s[k] != "\n") and not s.startswith(quote, k):
                        depth += (s[k] == "{") - (s[k] == "}")
                        k += 1
                if k >= n or s[k] != "}":
                    return self.add("ERR", at, min(n, k + 1))
                k = self.add("}$", k, k + 1)
            elif doubled and c == "}":
                return self.add("ERR", k, k + 1)
            else:
                k += 1
        return self.add("ERR", at, n)


def tokens(text: str, language: str) -> list[Token]:
    lexer = _Lexer(text, language)
    lexer.run(1 if text.startswith("﻿") else 0)
    if language == "python":
        return _layout(lexer.out, text)
    if language == "go":
        return _semicolons(lexer.out)
    return lexer.out


def _semicolons(found: list[Token]) -> list[Token]:
    """Go's rule: a line that ends in a value or a closing bracket ends a statement."""
    ends = {"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
    out: list[Token] = []
    for t in found:
        if t.new_line and out and out[-1].kind in ends:
            out.append(Token(";", out[-1].end, out[-1].end))
        out.append(t)
    if out and out[-1].kind in ends:
        out.append(Token(";", out[-1].end, out[-1].end))
    return out


def _layout(found: list[Token], text: str) -> list[Token]:
    """NEWLINE, INDENT and DEDENT of Python; lines within brackets and strings with holes go on."""
    out: list[Token] = []
    levels, depth, holes = [0], 0, 0
    for t in found:
        if t.new_line and depth <= 0 and holes == 0:
            if out:
                out.append(Token("NEWLINE", out[-1].end, out[-1].end))
            begin = text.rfind("\n", 0, t.start) + 1
            width = 0
            for c in text[begin : t.start]:
                width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + (c != "﻿")
            if not out and width:
                out.append(Token("INDENT", t.start, t.start))
                levels.append(width)
            elif width > levels[-1]:
                out.append(Token("INDENT", t.start, t.start))
                levels.append(width)
            while width < levels[-1]:
                levels.pop()
                out.append(Token("DEDENT" if width >= levels[-1] or len(levels) > 1 else "ERR", t.start, t.start))
                if width > levels[-1]:
                    out.append(Token("ERR", t.start, t.start))
                    break
            depth = 0
        if t.kind in ("(", "[", "{"):
            depth += 1
        elif t.kind in (")", "]", "}"):
            depth -= 1
        elif t.kind == "SB":
            holes += 1
        elif t.kind == "SE":
            holes -= 1
        out.append(t)
    if found:
        out.append(Token("NEWLINE", len(text), len(text)))
    out += [Token("DEDENT", len(text), len(text))] * (len(levels) - 1)
    return out

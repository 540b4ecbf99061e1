"""Sentences of texts in many languages and scripts.

A text is first cut into blocks (paragraphs, headings, list items; fenced code drops out). Within a block each character
is tagged as boundary or inside by a linear-chain conditional random field. Only places that could end a sentence (end marks
with what follows them; in a script without marks, white space) may be tagged as boundary, so the Viterbi search steps from
one such place to the next; between them the tag is inside. Weights of places and of transitions (by the tag before and the
distance from it) are learned together, from the corpus itself: the end of a block followed by the start of the next is a
boundary; a mark before a lower-case word, or after a token that the whole corpus never puts at the end of a block, or
between a number and a word that the corpus puts there but never at the start of a block, is inside; other places have no
label, and the likelihood of the labels is summed over their tags. For Thai the blocks are joined without their marks, and
white space where blocks practically never end or begin is labelled inside.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.scale import spread

#: Texts, and characters of each, that the chain's weights are fitted on (the token counts cover all texts), and the most
#: places in a row that a training sequence has.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_PLACES = 4000, 20_000, 48
#: Upper bounds, in characters, of the distances between places that transitions tell apart; longer ones would learn the
#: usual length of sentences and join runs of short ones.
DISTANCES = (4,)
#: Occurrences from which a token or word is counted as one that never ends or begins a block.
SUPPORT, ORDINAL_SUPPORT = 30, 10
#: The longest token, in characters, that is counted, and the most tokens that are sent to all tasks.
TOKEN_CHARS, TOKENS = 8, 50_000
_DIM = 1 << 18

# Marks, closers and openers, and abbreviations that seed the weak labels.
_MARKS = ".!?…。！？｡؟۔।॥።;;"
_CJK = "…。！？｡"
_CLOSERS = "\"'”’»)]}」』）】〉》“"
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "«": "»", "“": "”", "„": "“", '"': '"'}
_SEED = frozenset(
    "dr mr mrs ms prof st sr sra nr fig figs sec eq vol eds e.g i.e vs approx incl cf"
    " z h vgl abb bzw ca ex ej env aprox см рис разд π.χ д-р डॉ".split()
)
_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|\Z)")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
_BULLET = re.compile(r"[ \t]*[-*+•][ \t]+(?=\S)")
_NUMBER = re.compile(r"[ \t]*(\d{1,9})[.)][ \t]+(?=\S)")
_CANDIDATE = re.compile(rf"[{re.escape(_MARKS)}]+")
_NO_TOKEN = frozenset("\"'“”«»„()[]{}「」（）。！？…")
_THAI_SPACE = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
_THAI = re.compile(r"[฀-๿]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_CASELESS = re.compile(r"[֐-࿿ᄀ-ᇿ぀-鿿가-힯]")
_KANA_HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the paragraphs, items and headings of a text, with marks and surrounding space left out."""
    start = end = None
    fence = ""
    number: int | None = None  # of the list item that the lines stand in
    in_list = False
    kind = "text"
    for m in _LINE.finditer(text):
        line, at = m[1], m.start()
        if at == len(text) and not line:
            break
        if at == 0 and line.startswith("﻿"):
            line, at = line[1:], 1
        if fence:
            if (f := _FENCE.match(line)) and f[1].startswith(fence) and not line[f.end() :].strip():
                fence = ""
            continue
        c = line.lstrip()[:1]
        f = _FENCE.match(line) if c in ("`", "~") else None
        heading = _HEADING.match(line) if c == "#" else None
        bullet = _BULLET.match(line) if c and c in "-*+•" else None
        numbered = _NUMBER.match(line) if c.isdigit() else None
        if numbered and start is not None and int(numbered[1]) != (1 if in_list and number is None else -1 if number is None else number + 1):
            numbered = None  # a wrapped line that happens to begin with a number
        blank = not c
        if blank or f or heading or bullet or numbered:
            if start is not None:
                yield start, end, kind
            start = None
        if f:
            fence = f[1][:3]
            in_list, number = False, None
        elif blank:
            in_list = False
        elif heading:
            in_list, number = False, None
            body = line[heading.end() :].rstrip()
            if body:
                yield at + heading.end(), at + heading.end() + len(body), "heading"
        else:
            skip = bullet or numbered
            if skip:
                in_list = True
                number = int(numbered[1]) if numbered else None
            elif start is None and not in_list:
                number = None
            body = line[skip.end() :] if skip else line
            lead = len(body) - len(body.lstrip())
            offset = at + (skip.end() if skip else 0)
            if start is None:
                start, kind = offset + lead, "item" if skip else "text"
            end = offset + len(body.rstrip())
    if start is not None:
        yield start, end, kind


def _shields(block: str) -> list[tuple[int, int]]:
    """The spans between paired quotes and brackets of any length, outermost first come.

    A straight quote between a space and a word opens; it never closes what an earlier one left open.
    """
    spans, stack = [], []
    for m in re.finditer(r"[()\[\]（）「」『』【】《》«»“”„\"]", block):
        c, at = m[0], m.start()
        if stack and c == stack[-1][0] and not (c == '"' and at and block[at - 1].isspace() and not block[at + 1 : at + 2].isspace() and at + 1 < len(block)):
            spans.append((stack.pop()[1], at))
        elif c in _PAIRS and not (c == '"' and at and not block[at - 1].isspace() and block[at - 1] not in "([（"):
            if c == '"' and stack and stack[-1][0] == c:
                stack.pop()
            stack.append((_PAIRS[c], at))
    return spans


def _next_class(rest: str) -> str:
    """What kind of start follows: the first word of ``rest``."""
    m = re.match(r"[\"'“„«「(\[¿¡（`]*(\S*)", rest)
    word = m[1]
    if not rest:
        return "end"
    opener = "q" if m.end(0) - len(word) > 0 else ""
    if not word:
        return opener + "none"
    c = word[0]
    if c.isdigit():
        return opener + "digit"
    if c.isupper():
        return opener + "upper"
    if c.islower():
        core = word.rstrip(".,;:!?)\"'”»")
        if re.search(r"[a-z][A-Z]|[./_]\w|\(\)|://", core):
            return opener + "name"
        return opener + ("mixed" if _CASELESS.search(word) else "lower")
    if c.isalpha() or c.isalnum():
        return opener + "caseless"
    return opener + "sign"


@dataclass
class _Place:
    """A place that may end a sentence: where it ends, and what speaks for or against."""

    end: int
    forced: bool | None
    form: tuple = ()  # token, sign, next class, shape, closed, cased; of a space the classes beside it
    token: str = ""
    next_class: str = ""
    cased: bool = True
    ordinal: str = ""  # the word after a small number with a full stop

    @property
    def features(self) -> tuple[str, ...]:
        if len(self.form) == 2:
            left, right = self.form
            return f"space={left}|{right}", f"left={left}", f"right={right}"
        token, sign, kind, shape, closed, c = self.form
        return f"b={token}", f"{sign}|{kind}|{c}", f"q={closed}|{kind}|{c}", f"bias|{sign}"


def _class_of(c: str) -> str:
    return "thai" if "\u0e00" <= c <= "\u0e7f" else "digit" if c.isdigit() else "latin" if c.isalpha() else "sign"


def _spaces(block: str) -> list[_Place]:
    """The runs of white space beside Thai letters; a sentence ends before the space."""
    return [_Place(m.start(), None, (_class_of(block[m.start() - 1]), _class_of(block[m.end()])), "", "space", False) for m in _THAI_SPACE.finditer(block)]


def _places(block: str) -> list[_Place]:
    gaps = _spaces(block) if _THAI.search(block) else []
    shields = _shields(block) if re.search(r"[(\[（「『【《«“„\"]", block) else []
    out: list[_Place] = []
    sentence = 0
    one_case = len(block) > 80 and not any(c.isupper() for c in block)  # then a small letter says nothing
    for m in _CANDIDATE.finditer(block):
        mark, at, end = m[0], m.start(), m.end()
        if mark == "." and block[end : end + 1].isalnum():
            continue  # within a name or number
        if mark[-1] in ";;":
            if mark != ";" and ";" not in mark or not _greek(block[sentence:at]):
                continue
        inside = [s for s in shields if s[0] < at < s[1]] if shields else []
        closed = False
        while end < len(block):
            c = block[end]
            if c in _CLOSERS and not (c in "\"“" and not inside):
                # a closer counts if it closes something, or directly follows the mark
                end += 1
                closed = True
                inside = [s for s in inside if s[1] >= end]
                continue
            if c in "   " and end + 1 < len(block) and block[end + 1] in "»" and any(s[1] == end + 1 for s in inside):
                end += 1
                continue
            break
        if inside:  # within a larger sentence
            continue
        cjk = mark[-1] in _CJK and mark != "…" or (mark[0] == "…" and at and _KANA_HAN.match(block[at - 1]) is not None)
        if end < len(block) and not block[end].isspace():
            if not (cjk or mark[-1] in "؟।॥۔") or block[end] in "，、；：,;:":
                continue
            if closed and not block[sentence:at].lstrip()[:1] in tuple(_PAIRS):
                continue  # what goes on after a quotation without a space is the larger sentence
        k = at
        while k and at - k < 60 and block[k - 1] not in _NO_TOKEN and not block[k - 1].isspace():
            k -= 1
        token = block[k:at].lstrip("¿¡`*_")
        low = token.lower()
        next_at = end
        while next_at < len(block) and block[next_at].isspace():
            next_at += 1
        following = block[next_at : next_at + 80]
        kind = _next_class(following)
        if one_case and kind in ("lower", "qlower"):
            kind = kind.replace("lower", "upper")
        last = block[at - 1 : at] if at else ""
        k = at - 1
        while k > 0 and not block[k].isalpha() and at - k < 12:
            k -= 1
        cased = _CASELESS.match(block[k]) is None if k >= 0 else True
        shape = (
            "none" if not token else "cap1" if len(token) == 1 and token.isupper() else "low1" if len(token) == 1 and token.islower()
            else "other1" if len(token) == 1 else "dots" if re.fullmatch(r"(?:\w\.)+\w", token) else "digit" if last.isdigit() else "short" if len(token) <= 3 else "long"
        )
        sign = "dot" if mark == "." else "ell" if mark[0] in ".…" else "cjk" if cjk else "qe"
        c = "c" if cased else "n"
        ordinal = following_word(following) if mark == "." and _small(token) else ""
        out.append(_Place(end, True if not following else None, (f"#{min(3, len(low))}" if low.isdigit() else low[-12:], sign, kind, shape, closed, c), low if mark == "." else "", kind, cased, ordinal))
        if out[-1].forced or kind not in ("lower", "qlower"):
            sentence = end
    if gaps:
        out = sorted({p.end: p for p in gaps + out}.values(), key=lambda p: p.end)
    return out


def _small(token: str) -> bool:
    return 0 < len(token) <= 2 and token.isdigit() and 0 < int(token) <= 31


def following_word(text: str) -> str:
    m = re.match(r"[^\W\d_]+", text)
    return m[0].lower() if m else ""


def _greek(part: str) -> bool:
    return len(_GREEK.findall(part)) >= 3


def _slot(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature) % _DIM


def _distance(chars: int) -> int:
    return bisect_right(DISTANCES, chars - 1)


class Model:
    """Weights of the chain; ``never`` are tokens that the corpus practically never puts at the end of a block, ``ordinals``
    words that it puts after a small number with a full stop but never at the start of a block.

    ``transitions[distance][before][tag]`` belong to steps from a tag (1: boundary) to the next place; a block begins after
    a boundary.
    """

    def __init__(self, weights: dict[int, float], transitions: list[list[list[float]]], never: frozenset[str], ordinals: frozenset[str] = frozenset()):
        self.weights, self.transitions, self.never, self.ordinals = weights, transitions, never, ordinals
        self._memory: dict[tuple, float] = {}

    def slots(self, place: _Place) -> list[int]:
        return [_slot(f) for f in _all_features(place, place.token in self.never, place.ordinal in self.ordinals)]

    def score(self, place: _Place) -> float:
        """What speaks for a boundary at a place, before what stands beside it counts."""
        key = (place.form, place.token in self.never, place.ordinal in self.ordinals)
        total = self._memory.get(key)
        if total is None:
            if len(self._memory) > 300_000:
                self._memory.clear()
            total = self._memory[key] = sum(self.weights.get(_slot(f), 0.0) for f in _all_features(place, *key[1:]))
        return total

    def tags(self, places: list[_Place]) -> list[bool]:
        """Viterbi over the places of a block: tag true for a boundary."""
        inside, boundary = -1e18, 0.0
        back = []
        previous = 0
        for p in places:
            s = 1e6 if p.forced else self.score(p)
            (ii, ib), (bi, bb) = self.transitions[_distance(p.end - previous)]
            from_b_on, from_i_on = boundary + bb, inside + ib
            from_b_off, from_i_off = boundary + bi, inside + ii
            back.append((from_b_off >= from_i_off, from_b_on >= from_i_on))  # whether the tag before is a boundary
            inside, boundary = max(from_b_off, from_i_off), max(from_b_on, from_i_on) + s
            previous = p.end
        state = boundary > inside
        out = []
        for off, on in reversed(back):
            out.append(state)
            state = on if state else off
        return out[::-1]


def _all_features(place: _Place, never: bool, ordinal: bool) -> tuple[str, ...]:
    if len(place.form) == 2:
        return place.features
    _, sign, kind, shape, _, _ = place.form
    known = never or place.token in _SEED
    return *place.features, f"{shape}|{sign}|{known}", f"{shape}|{kind}|{sign}|{known}", f"never={never}|{place.next_class == 'end'}", f"ordinal={ordinal}"


_BEFORE_STOP = re.compile(r"(?<![^\s\"'“”«»„()\[\]{}「」（）。！？…])([^\s\"'“”«»„()\[\]{}「」（）。！？….]+(?:\.[^\s\"'“”«»„()\[\]{}「」（）。！？….]+)*)\.(?=[\"'”’»)\]]*(?:\s|\Z))")
_NUMBERED = "#"  # before words that follow a number; no token before a full stop is counted with it


def _counted(block: str) -> Iterator[tuple[str, bool]]:
    """The short tokens before the full stops of a block and whether nothing follows; words after a small number with a full
    stop (false) and words that begin a block (true), both behind ``#``."""
    if "." in block:
        for m in _BEFORE_STOP.finditer(block):
            token = m[1].lstrip("¿¡`*_").lower()
            if 0 < len(token) <= TOKEN_CHARS:
                yield token, m.end() >= len(block) - 3 and not block[m.end() :].strip("\"'”’»)] ")
                if _small(token) and (word := following_word(block[m.end() : m.end() + 60].lstrip())):
                    yield _NUMBERED + word, False
    if word := following_word(block):
        yield _NUMBERED + word, True


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n, n_final: how often each short token stands before a full stop, and how often that ends a block.

    Tokens behind ``#`` are words after a number (n) and at the start of blocks (n_final). Counts all texts; they combine
    within each task before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text in b.column(0).to_pylist():
                for start, end, kind in blocks(text):
                    if kind != "heading":
                        for token, final in _counted(text[start:end]):
                            n[token][0] += not (final and token[0] == _NUMBERED)
                            n[token][1] += final
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], ["token", "n", "n_final"]
            )

    return docs.select("text").filter(F.col("text").isNotNull()).mapInArrow(count, "token string, n bigint, n_final bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))


def _labelled(parts: list[tuple[str, str]], model: Model, thai: tuple[frozenset, frozenset]) -> Iterator[list[tuple[list[int], int, int]]]:
    """The training sequences of a text's blocks: (feature slots, distance, label) of places; label -1 where none is known."""
    for i, (block, kind) in enumerate(parts):
        if kind == "heading":
            continue
        follow = next((b for b, k in parts[i + 1 :] if k != "heading"), None)
        bare = _THAI.search(block) is not None
        if bare:  # a script that does without marks is learned without them
            block = _CANDIDATE.sub("", block).rstrip()
            follow = follow and _CANDIDATE.sub("", follow).lstrip()
        if not block:
            continue
        joined = _places(block + " " + follow[:80]) if follow else _places(block)
        out, previous = [], 0
        for p in joined:
            if p.end > len(block) or p.forced:
                break
            label = -1
            if p.end == len(block) and follow:
                label = 1 if p.token not in model.never else -1
            elif len(p.form) == 2:
                label = 0 if p.form[0] not in thai[0] or p.form[1] not in thai[1] else -1
            elif p.ordinal in model.ordinals or (p.next_class in ("lower", "qlower") and p.cased) or (p.token and (p.token in model.never or (p.token in _SEED and p.next_class != "end"))):
                label = 0
            out.append((model.slots(p), _distance(p.end - previous), label))
            previous = p.end
        for at in range(0, len(out), SAMPLE_PLACES):
            part = out[at : at + SAMPLE_PLACES]
            if any(x[2] >= 0 for x in part):
                yield part


def sample_of(texts: DataFrame, column: str, n: int) -> DataFrame:
    """About ``n`` distinct rows of ``texts``, chosen by the hash of ``column``: the same rows whatever the order.

    Only the chosen rows move. Rows with one text are chosen together and count once.
    """
    rows = texts.withColumn("__h", F.xxhash64(column))
    there = rows.agg(F.count(F.lit(1))).first()[0]
    if there > n:
        rows = rows.filter(F.pmod("__h", F.lit(1 << 30)) < F.lit(int((1 << 30) * n / there)))
    return rows.drop("__h").distinct()


def fit(docs: DataFrame) -> Model:
    """A model from the texts themselves; the same texts give the same model. Nothing but labelled places comes to the driver."""
    counts = token_counts(docs).filter((F.col("n") >= ORDINAL_SUPPORT) & (F.col("n_final") * 100 <= F.col("n"))).orderBy(F.desc("n"), "token").limit(TOKENS).collect()
    never = frozenset(r.token for r in counts if r.token[0] != _NUMBERED and r.n >= SUPPORT)
    ordinals = frozenset(r.token[1:] for r in counts if r.token[0] == _NUMBERED)
    blank = Model({}, [], never, ordinals)
    sample = sample_of(docs.select("text").filter(F.length("text") <= SAMPLE_CHARS), "text", SAMPLE_TEXTS)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for start, end, kind in blocks(text):
                    part = _CANDIDATE.sub("", text[start:end]).strip()
                    if kind != "heading" and _THAI.search(part):
                        n["first", _class_of(part[0])] += 1
                        n["last", _class_of(part[-1])] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["side", "class", "n"])

    sides = sample.mapInArrow(edges, "side string, class string, n bigint").groupBy("side", "class").agg(F.sum("n").alias("n")).collect()
    usual = {side: frozenset(r["class"] for r in sides if r.side == side and r.n * 100 > sum(x.n for x in sides if x.side == side)) for side in ("last", "first")}
    thai = (usual["last"], usual["first"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                rows += list(_labelled([(text[s:e], k) for s, e, k in blocks(text)], blank, thai))
            yield pa.RecordBatch.from_arrays(
                [pa.array([[x for p in r for x in p[0]] for r in rows], pa.list_(pa.int32())), pa.array([[len(p[0]) for p in r] for r in rows], pa.list_(pa.int32())),
                 pa.array([[p[1] for p in r] for r in rows], pa.list_(pa.int32())), pa.array([[p[2] for p in r] for r in rows], pa.list_(pa.int32()))],
                ["slots", "sizes", "distances", "labels"],
            )

    found = sample.mapInArrow(label, "slots array<int>, sizes array<int>, distances array<int>, labels array<int>").groupBy("slots", "sizes", "distances", "labels").agg(F.count(F.lit(1)).alias("n"))
    rows = found.toPandas()
    rows["key"] = [str(list(x)) + str(list(y)) for x, y in zip(rows["slots"], rows["labels"])]
    rows = rows.sort_values("key", kind="stable")
    weights, transitions = _chain(rows["slots"].tolist(), rows["sizes"].tolist(), rows["distances"].tolist(), rows["labels"].tolist(), rows["n"].to_numpy(float))
    return Model(weights, transitions, never, ordinals)


def _chain(slots: list, sizes: list, distances: list, labels: list, counts: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> tuple[dict[int, float], list[list[list[float]]]]:
    """Fit a chain with two tags by AdaGrad on the likelihood of the known labels, summed over the tags of other places.

    Forward and backward sums run over all sequences at once, place by place.
    """
    groups = len(DISTANCES) + 1
    if not len(slots):
        return {}, np.zeros((groups, 2, 2)).tolist()
    # sequences by falling length, places by their number in the sequence: step j works on a run of places without gaps
    order = np.argsort([-len(x) for x in sizes], kind="stable")
    lengths = np.array([len(sizes[i]) for i in order])
    active = [int((lengths > j).sum()) for j in range(int(lengths[0]))]
    starts = np.concatenate([[0], np.cumsum(active)])
    places = int(starts[-1])
    gap, known, owner = np.zeros(places, dtype=np.int64), np.zeros(places, dtype=np.int64), np.zeros(places, dtype=np.int64)
    wide = max(max(x) for x in sizes)
    x = np.full((places, wide), _DIM, dtype=np.int64)
    for k, i in enumerate(order):
        at = 0
        for j, size in enumerate(sizes[i]):
            p = starts[j] + k
            x[p, :size] = slots[i][at : at + size]
            gap[p], known[p], owner[p] = distances[i][j], labels[i][j], k
            at += size
    counts = counts[order]
    forms, form = np.unique(x, axis=0, return_inverse=True)  # places of one kind share their score
    form = form.ravel()
    used, forms = np.unique(forms, return_inverse=True)
    forms = forms.reshape(-1, wide)
    pad = used == _DIM
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    t, t2 = np.zeros((groups, 2, 2)), np.full((groups, 2, 2), 1e-8)
    # what is known enters as two halves of equal weight: the boundaries alone, and what is inside alone
    halves = []
    for label in (1, 0):
        ruled_out = np.zeros((places, 2))  # the logarithm of nought for the tag that a label rules out
        ruled_out[known == label, 1 - label] = -1e9
        share = np.where(np.bincount(owner, known == label, len(lengths)) > 0, counts, 0.0)
        halves.append((ruled_out, (share / max(share.sum(), 1.0))[owner]))
    weight = sum(h[1] for h in halves)

    def expected(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a boundary at each place and of each step under the chain."""
        step = t[gap]
        forward, backward = np.zeros((places, 2)), np.zeros((places, 2))
        forward[: active[0]] = step[: active[0], 1] + emit[: active[0]]
        for j in range(1, len(active)):
            here, before = slice(starts[j], starts[j] + active[j]), slice(starts[j - 1], starts[j - 1] + active[j])
            a = forward[before, :, None] + step[here]
            forward[here] = np.logaddexp(a[:, 0], a[:, 1]) + emit[here]
        for j in range(len(active) - 1, 0, -1):
            here, before = slice(starts[j], starts[j] + active[j]), slice(starts[j - 1], starts[j - 1] + active[j])
            a = step[here] + (emit[here] + backward[here])[:, None, :]
            backward[before] = np.logaddexp(a[..., 0], a[..., 1])
        both = forward + backward
        z = np.logaddexp(both[: active[0], 0], both[: active[0], 1])[owner]
        pair = np.zeros((places, 2, 2))
        pair[: active[0], 1] = np.exp(both[: active[0]] - z[: active[0], None])
        for j in range(1, len(active)):
            here, before = slice(starts[j], starts[j] + active[j]), slice(starts[j - 1], starts[j - 1] + active[j])
            pair[here] = np.exp(forward[before, :, None] + step[here] + (emit[here] + backward[here])[:, None, :] - z[here, None, None])
        return np.exp(both[:, 1] - z), pair

    for _ in range(rounds):
        emit = np.zeros((places, 2))
        emit[:, 1] = w[forms].sum(1)[form]
        free_place, free_pair = expected(emit)
        error, steps = free_place * weight, free_pair * weight[:, None, None]
        for ruled_out, share in halves:
            held_place, held_pair = expected(emit + ruled_out)
            error -= held_place * share
            steps -= held_pair * share[:, None, None]
        error = np.bincount(form, error, len(forms))
        g = np.bincount(forms.ravel(), np.repeat(error, wide), len(used)) + decay * w
        g[pad] = 0
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gt = np.stack([np.bincount(gap, steps[:, i, j], groups) for i in (0, 1) for j in (0, 1)], 1).reshape(groups, 2, 2) + decay * t
        t2 += gt * gt
        t -= rate * gt / np.sqrt(t2)
    return {int(k): float(v) for k, v in zip(used, w) if k != _DIM}, t.tolist()


def _logistic(rows: list[list[int]], labels: list[float], rounds: int = 60, rate: float = 0.5, decay: float = 1e-5, dim: int = _DIM, balanced: bool = True) -> dict[int, float]:
    """Logistic regression by full-batch AdaGrad over sparse 0/1 features."""
    if not rows:
        return {}
    width = max(map(len, rows))
    x = np.array([r + [dim] * (width - len(r)) for r in rows])
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(len(rows), width)
    y = np.array(labels)
    share = y.mean()
    balance = np.ones(len(y)) if not balanced else np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    pad = used == dim
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-w[x].sum(1)))
        g = np.bincount(x.ravel(), np.repeat((p - y) * balance / len(y), width), len(used)) + decay * w
        g[pad] = 0
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return {int(k): float(v) for k, v in zip(used, w) if k != dim}


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text in code points."""
    out = []
    for start, end, kind in blocks(text):
        block = text[start:end]
        cuts = [] if kind == "heading" else _places(block)
        ends = [p.end for p, boundary in zip(cuts, model.tags(cuts)) if boundary]
        at = 0
        for e in [*ends, len(block)]:
            part = block[at:e]
            body = part.strip()
            if body:
                lead = len(part) - len(part.lstrip())
                out.append((start + at + lead, start + at + lead + len(body)))
            at = e
    return out


def sentences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, start_pos, end_pos: one row per sentence of each text (doc_id, text).

    Null, empty and blank texts have none. A repeated row repeats its sentences. The model is fitted on
    ``docs`` unless one is given.
    """
    texts = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull()))
    fitted = model or fit(texts)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in split(text, fitted):
                    ids.append(doc)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    return texts.mapInArrow(run, f"doc_id {key}, start_pos int, end_pos int")

"""Passages of a stated set of evaluation texts inside a corpus: a prefix-filtered set join over word shingles.

The evaluation texts are the query set: it is sent to all tasks in blocks of bounded size, and the corpus, which is
never shuffled, passes by each block once. The pass counts in how many texts each shingle of the block stands and keeps, as
hashes of their words, the texts with as many of them as the least match has. For every window that a case must contain, the
rarest shingles are chosen, by their counts in the whole corpus, just so many that any match within the allowed replacements
keeps one of them. Kept texts that hold a chosen shingle are aligned with the item there and verified exactly.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.scale import cut, spread

#: Characters of evaluation text that go to the tasks at once.
BLOCK_CHARS = 2_000_000
#: Words (for Chinese characters) from which a sentence that several items share is no longer the item's own.
SHARED_TOKENS = 5

_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_HIDDEN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


@dataclass(frozen=True)
class Rule:
    """What makes a case: ``least`` tokens in a row, of which one in ``one_in`` (0: none) may be replaced.

    Every case contains one of ``windows`` (length, replacements): a run that is twice as long as the least one falls
    in two, one of which keeps to the share, so a smallest one is shorter than that, and among these the
    lengths at which one more replacement is allowed are enough.
    """

    least: int
    one_in: int
    shingle: int
    windows: tuple[tuple[int, int], ...]

    def prefix(self, length: int, replaced: int) -> int:
        """Shingles of a window of which a match keeps at least one: all but those it surely keeps, plus one."""
        return length - self.shingle + 1 - max(1, length - self.shingle + 1 - replaced * self.shingle) + 1

    def sure(self) -> int:
        """Places of shingles of the item that any match has."""
        return min(max(1, length - self.shingle + 1 - replaced * self.shingle) for length, replaced in self.windows)


WORDS = Rule(12, 5, 3, ((12, 2), (15, 3), (20, 4)))
CHARACTERS = Rule(20, 0, 5, ((20, 0),))


def words(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, layout and characters that do not show."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text))
    return _TOKEN.findall(text.casefold())


class _Hash(dict):
    """64-bit hashes of tokens, remembered; it empties itself, so it never grows beyond a bound."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


def _hashes(tokens, memory: _Hash) -> np.ndarray:
    return np.fromiter((memory[t] for t in tokens), dtype=np.uint64, count=len(tokens))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return reduce(lambda a, b: a + b, ((h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> np.uint64(29))) * _K[i] for i in range(k)))


def _is_han(text: str) -> bool:
    return 2 * len(_HAN.findall(text)) > len(re.findall(r"[^\W\d_]", text))


@dataclass
class _Item:
    item_id: int | None
    tokens: np.ndarray
    own: np.ndarray  # false for tokens of sentences that several items share
    rule: Rule


@dataclass
class _Block:
    items: list[_Item] = field(default_factory=list)

    def wanted(self, rule: Rule) -> np.ndarray:
        """All shingles of the items under a rule, sorted."""
        parts = [_shingles(x.tokens, rule.shingle) for x in self.items if x.rule is rule]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)

    def prefixes(self, rule: Rule, counts: dict[int, int]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        """The chosen shingles, sorted, and where each stands (item, position)."""
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, x in enumerate(self.items):
            if x.rule is not rule:
                continue
            s = _shingles(x.tokens, rule.shingle).tolist()
            rarity = [(counts.get(h, 0), h, at) for at, h in enumerate(s)]
            chosen: set[int] = set()
            for length, replaced in rule.windows:
                for start in range(len(x.tokens) - length + 1):
                    if x.own[start : start + length].all():
                        for _, _, at in sorted(rarity[start : start + length - rule.shingle + 1])[: rule.prefix(length, replaced)]:
                            chosen.add(at)
            for at in chosen:
                places[s[at]].append((n, at))
        return np.array(sorted(places), dtype=np.uint64), places


def _contains(item: _Item, text: np.ndarray, shift: int) -> tuple[int, int] | None:
    """Verify the alignment item[i] ~ text[i + shift]: (start, end) in the text of a case, else null.

    A run begins and ends with a word that agrees.
    """
    rule = item.rule
    low, high = max(0, -shift), min(len(item.tokens), len(text) - shift)
    if high - low < rule.least:
        return None
    same = (item.tokens[low:high] == text[low + shift : high + shift]) & item.own[low:high]
    worth = np.where(same, 1, 1 - rule.one_in if rule.one_in else -(1 << 40)).astype(np.int64)
    worth[~item.own[low:high]] = -(1 << 40)
    total = np.concatenate([[0], np.cumsum(worth)])
    begin = np.where(same, total[:-1], 1 << 60)
    lowest = np.minimum.accumulate(begin)
    ends = np.arange(rule.least, len(same) + 1)
    good = same[ends - 1] & (total[ends] >= lowest[ends - rule.least])
    if not good.any():
        return None
    end = int(ends[good][0])
    start = int(np.argmin(begin[: end - rule.least + 1]))
    return low + shift + start, low + shift + end


def _tokenised(text: str, memory: _Hash, want_chars: bool, want_words: bool):
    """(rule, hashes) of a text for each rule that applies to it."""
    w = words(text)
    if want_words and len(w) >= WORDS.least:
        yield WORDS, _hashes(w, memory)
    if want_chars and _HAN.search(text):
        yield CHARACTERS, _hashes("".join(w), memory)


def _blocks(items: DataFrame) -> list[_Block]:
    """The query set in blocks, with the tokens of shared sentences marked."""
    memory = _Hash()
    rows = [(r.item_id, r.text) for r in items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator()]
    sentences = [(i, [words(s) for s in _SENTENCE.split(t)], _is_han(t), len(t)) for i, t in rows]
    holders: dict[tuple, set] = defaultdict(set)
    for i, parts, _, _ in sentences:
        for s in parts:
            holders[tuple(s)].add(i)
    blocks, size = [_Block()], 0
    for i, parts, han, chars in sentences:
        if size and size + chars > BLOCK_CHARS:
            blocks.append(_Block())
            size = 0
        size += chars
        tokens: list[str] = []
        own: list[bool] = []
        for s in parts:
            t = list("".join(s)) if han else s
            tokens += t
            own += [not (len(holders[tuple(s)]) > 1 and len(t) >= SHARED_TOKENS)] * len(t)
        blocks[-1].items.append(_Item(i, _hashes(tokens, memory), np.array(own, dtype=bool), CHARACTERS if han else WORDS))
    return blocks


_PASSED = "h bigint, n bigint, doc_id {0}, chars boolean, tokens array<bigint>"


def _pass(docs: DataFrame, block: _Block) -> DataFrame:
    """One pass of the corpus: rows (h, n), in how many texts of a task a shingle of the block stands, and rows (doc_id,
    chars, tokens), the texts with as many places of such shingles as a match has at least, as hashes of their tokens.

    A text with fewer places cannot hold a case, so none is lost.
    """
    wanted = {rule: block.wanted(rule) for rule in (WORDS, CHARACTERS)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, n, kept = _Hash(), Counter(), []

        def rows(h, counts, ids, rules, tokens, key):
            sizes = np.cumsum([0, *([0] * len(h)), *map(len, tokens)])
            flat = np.concatenate([np.empty(0, np.uint64), *tokens]).view(np.int64)
            none = [None] * len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([*h, *none], pa.int64()), pa.array([*counts, *none], pa.int64()), pa.array([None] * len(h) + ids, key), pa.array([None] * len(h) + rules, pa.bool_()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))],
                ["h", "n", "doc_id", "chars", "tokens"],
            )

        key = None
        for b in batches:
            key, ids, rules, tokens = b.schema.field(0).type, [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for rule, h in _tokenised(text, memory, len(wanted[CHARACTERS]) > 0, len(wanted[WORDS]) > 0):
                    s = _shingles(h, rule.shingle)
                    there = s[_member(s, wanted[rule])]
                    if len(there):
                        n.update(np.unique(there).tolist())
                    if len(there) >= rule.sure():
                        ids.append(doc)
                        rules.append(rule == CHARACTERS)
                        tokens.append(h)
            if ids:
                yield rows([], [], ids, rules, tokens, key)
        if n:
            yield rows(np.fromiter(n, np.uint64, len(n)).view(np.int64).tolist(), list(n.values()), [], [], [], key)

    return docs.mapInArrow(run, _PASSED.format(kind))


def _shingle_counts(passed: DataFrame) -> dict[int, int]:
    """The document counts of the block's shingles over the whole corpus; as many numbers as the block has shingles."""
    counted = passed.filter(F.col("h").isNotNull()).groupBy("h").agg(F.sum("n").alias("n"))
    return {int(np.int64(r.h).view(np.uint64)): r.n for r in counted.toLocalIterator()}


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, first_word, last_word: each leaked item with each text (doc_id, text) that contains a passage.

    A passage is at least 12 words in a row of which up to one in five is another word, or, of an item in Chinese, at
    least 20 characters in a row unchanged; places count from 0 in the text's words (characters of words), and are those
    of the first passage found. Sentences of several items belong to none. Null, empty and short texts hold nothing;
    repeated rows of a text give one row; a null id stays null. No items or no texts give an empty result.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema] if f.name in ("doc_id", "item_id")}
    schema = f"item_id {kind['item_id']}, doc_id {kind['doc_id']}, first_word int, last_word int"
    texts = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull()))
    parts = []
    for block in _blocks(items):
        passed = cut(_pass(texts, block))
        parts.append(_found(passed.filter(F.col("h").isNull()).select("doc_id", "chars", "tokens"), block, _shingle_counts(passed), schema))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("item_id", "doc_id").agg(F.min(F.struct("first_word", "last_word")).alias("at")).select("item_id", "doc_id", "at.first_word", "at.last_word")


def _found(kept: DataFrame, block: _Block, counts: dict[int, int], schema: str) -> DataFrame:
    chosen = {rule: block.prefixes(rule, counts) for rule in (WORDS, CHARACTERS)}
    items = block.items

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            lists = b.column(2)
            at_of, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, (doc, chars) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = flat[at_of[i] : at_of[i + 1]]
                rule = CHARACTERS if chars else WORDS
                keys, places = chosen[rule]
                s = _shingles(h, rule.shingle)
                tried: set[tuple[int, int]] = set()
                done: set[int] = set()
                for at in np.flatnonzero(_member(s, keys)).tolist():
                    for n, start in places[int(s[at])]:
                        if n in done or (n, at - start) in tried:
                            continue
                        tried.add((n, at - start))
                        if passage := _contains(items[n], h, at - start):
                            done.add(n)
                            rows.append((items[n].item_id, doc, passage[0], passage[1] - 1))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], b.schema.field(0).type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                ["item_id", "doc_id", "first_word", "last_word"],
            )

    return kept.mapInArrow(find, schema)

"""Encoding of a corpus with a byte-level BPE vocabulary through a table of its distinct words.

The texts are split into words in the JVM and each distinct word is encoded once. The ids of the commonest words, a list of
bounded size that every task gets, are joined to their places without a shuffle, a batch of texts at a time; only the other
words travel, by word to their ids and by document to their places.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.scale import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of the vocabulary, with white space spelt out as Unicode has it.
_SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The most words, and the most characters of each, that every task gets.
HEAD_WORDS, HEAD_CHARS = 1 << 16, 100
#: A word is hot among the others if it is more than one in so many of their occurrences, and is spread over as many salts
#: as it has shares of that size, so no task gets much more than such a share.
HOT_SHARE = 1000


def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}


def _read(path: str) -> bytes:
    """The vocabulary file, read where the job starts; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(vocabulary: bytes):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(vocabulary), special_tokens={})


def word_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word, n (occurrences) and ids: each distinct word of ``docs.text`` once. Counts combine before the shuffle."""

    shipped = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for b in batches:
            ids = [encoder.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    counts = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.mapInArrow(encode, "word string, n bigint, ids array<int>")


class _Head:
    """The ids of the commonest words, looked up for whole batches of texts at once."""

    def __init__(self, words: list[str], ids: list[list[int]]):
        self.words = pa.array(words, pa.string())
        self.sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.ids = np.fromiter((i for x in ids for i in x), np.int32, int(self.sizes.sum()))

    def place(self, words: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
        """Per text: the ids between the words that are not in the list (one run more than such words), and these words."""
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(words)
        at = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(n)), n)
        hole = at < 0
        run = text + np.cumsum(hole) - hole  # each text has a run of its own beyond those that its holes end
        known = at[~hole]
        sizes = self.sizes[known]
        total = int(sizes.sum())
        ids = self.ids[np.repeat(self.starts[known] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]
        holes = np.bincount(text[hole], minlength=len(n))
        per_run = np.bincount(run[~hole], sizes, len(n) + int(hole.sum())).astype(np.int64)
        offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets(holes + 1), pa.ListArray.from_arrays(offsets(per_run), pa.array(ids, pa.int32())))
        return runs, pa.ListArray.from_arrays(offsets(holes), flat.filter(pa.array(hole)))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each document, without special tokens.

    A null or empty text has the empty list; strings that look like special tokens are ordinary text. Rows that repeat
    an id and its text count once; an id with several texts has a row for each, a null id likewise.
    """
    docs = docs.select("doc_id", "text")
    table = cut(word_table(docs, vocabulary))
    common = table.filter(F.length("word") <= HEAD_CHARS).orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select("word", "ids").collect()
    head = docs.sparkSession.sparkContext.broadcast(([r.word for r in common], [r.ids for r in common]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Head(*head.value)
        for b in batches:
            runs, others = known.place(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), runs, others], ["doc_id", "__text", "runs", "others"])

    key = docs.schema["doc_id"].dataType.simpleString()
    words = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    parts = cut(words.mapInArrow(place, f"doc_id {key}, __text bigint, runs array<array<int>>, others array<string>"))
    others = parts.select("doc_id", "__text", F.posexplode("others").alias("pos", "word"))
    # what the list leaves out, and among it the words, fewer than HOT_SHARE, that need more than one task
    listed = docs.sparkSession.createDataFrame([(r.word,) for r in common], "word string")
    rest = table.join(F.broadcast(listed), "word", "left_anti")
    total = rest.agg(F.sum("n").alias("__total"))
    hot = rest.crossJoin(F.broadcast(total)).filter(F.col("n") * HOT_SHARE > F.col("__total")).groupBy(F.xxhash64("word").alias("__h")).agg(F.max(F.ceil(F.col("n") * HOT_SHARE / F.col("__total"))).cast("int").alias("__salts"))
    hot = F.broadcast(cut(hot))
    salted = others.withColumn("__h", F.xxhash64("word")).join(hot, "__h", "left").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "__text", "pos"), F.coalesce("__salts", F.lit(1))))
    copies = rest.withColumn("__h", F.xxhash64("word")).join(hot, "__h", "left").select("word", "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.coalesce("__salts", F.lit(1)) - 1).cast("bigint"))).alias("__salt"))
    placed = salted.join(copies, ["word", "__salt"]).select("doc_id", "__text", F.lit(None).cast("array<array<int>>").alias("runs"), F.struct("pos", "ids").alias("other"))
    every = parts.select("doc_id", "__text", "runs", F.lit(None).cast(placed.schema["other"].dataType).alias("other")).unionByName(placed)
    filled = every.groupBy("doc_id", "__text").agg(F.max("runs").alias("runs"), F.array_sort(F.collect_set("other")).alias("o"))
    ids = F.flatten(F.transform("runs", lambda run, i: F.concat(run, F.coalesce(F.get("o", i)["ids"], F.array().cast("array<int>")))))
    return filled.select("doc_id", ids.alias("ids"))


def pieces(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and piece (the bytes in hexadecimal) of a vocabulary; its size is fixed by the file."""
    rows = [(rank, piece.hex()) for piece, rank in _ranks(_read(vocabulary)).items()]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids), through a join of ids to pieces.

    An empty or null list has the empty text. Ids outside the vocabulary have no bytes. Broken UTF-8, which only ids
    that no text encodes to can give, becomes replacement characters.
    """
    encoded = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("__ids"))
    known = F.broadcast(pieces(encoded.sparkSession, vocabulary))  # fixed: 50,256 rows
    parts = encoded.select("doc_id", "__ids", F.posexplode("ids").alias("pos", "id")).join(known, "id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    filled = parts.groupBy("doc_id", "__ids").agg(F.decode(F.unhex(joined), "UTF-8").alias("text")).select("doc_id", "text")
    empty = encoded.filter(F.col("ids").isNull() | (F.size("ids") == 0)).select("doc_id", F.lit("").alias("text")).distinct()
    return filled.unionByName(empty)

"""Encoding a corpus with a public byte-level BPE vocabulary, each distinct word once.

1. Texts are cut into pre-tokens in blocks of bounded length. A block yields its
   distinct words and, per text, the numbers of its words in order of position.
2. Distinct words of the whole corpus meet in one shuffle and are encoded once.
3. Their ids go back to the blocks (a word has at most one row a block, however
   often it occurs), and every text is reassembled by position. Words that stand in
   very many blocks are few and are broadcast; the others are joined by shuffle.

Neither texts nor tokens are shuffled: only dictionaries and word numbers are.
Decoding joins every token with the token-byte table, which is as large as the
vocabulary and no larger.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

BLOCK_CHARS = 1_000_000
#: A word is common if so many blocks have it, and more than one in so many of all rows: no more words than that can be.
COMMON_BLOCKS, COMMON_WORDS = 1000, 4096
CUT = "block long, id long, numbers binary, word_no int, word binary"


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    if not os.path.exists(path):  # on another machine than the driver: the copy that it sent
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})._core_bpe


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def _cut(it: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    find = _splitter(pattern).findall
    block = TaskContext.get().partitionId() << 32
    ids, rows, words, held = [], [], {}, 0

    def flush() -> pa.RecordBatch:
        kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
        n, w = len(ids), len(words)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + w, block)),
                pa.array(ids + [None] * w, pa.int64()),
                pa.array([np.array(r, kind).tobytes() for r in rows] + [None] * w, pa.binary()),
                pa.array([w] * n + list(range(w)), pa.int32()),  # a text's row has the size of the dictionary
                pa.array([None] * n + [x.encode("utf-8", "surrogatepass") for x in words], pa.binary()),
            ],
            names=["block", "id", "numbers", "word_no", "word"],
        )

    for batch in it:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            rows.append([words.setdefault(w, len(words)) for w in find(text or "")])
            held += len(text or "") + 20
            if held >= BLOCK_CHARS:
                yield flush()
                block += 1
                ids, rows, words, held = [], [], {}, 0
    if ids:
        yield flush()


def _encode(it: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path, pattern).encode_single_piece
    known = ranks(path)
    for b in it:
        words = b.column(0).to_pylist()
        ids = [[known[w]] if w in known else encode(w) for w in words]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n_blocks", "ids"])


def _assemble(texts: pa.Table, words: pa.Table, count_only: bool) -> pa.Table:
    """Ids (or their number) of every text of one block."""
    no = words.column("word_no").to_numpy()
    lists = words.column("ids").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.zeros(len(no), np.int64)
    start = np.zeros(len(no), np.int64)
    size[no], start[no] = np.diff(off), off[:-1]
    kind = np.uint16 if len(no) <= 1 << 16 else np.uint32
    seqs = [np.frombuffer(x, kind) for x in texts.column("numbers").to_pylist()]
    seq = np.concatenate(seqs) if seqs else np.zeros(0, kind)
    n = size[seq]
    ends = np.append(0, np.cumsum(n))
    cuts = ends[np.append(0, np.cumsum([len(s) for s in seqs])).astype(np.int64)]
    if count_only:
        return pa.table({"id": texts.column("id"), "n_tokens": pa.array(np.diff(cuts))})
    at = np.repeat(start[seq] - ends[:-1], n) + np.arange(ends[-1])
    ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat[at].astype(np.int32)))
    return pa.table({"id": texts.column("id"), "ids": ids})


def encode_corpus(df: DataFrame, id: str, text: str, *, vocabulary: str | None = None, pattern: str | None = None, count_only: bool = False, common_blocks: int = COMMON_BLOCKS) -> DataFrame:
    """``(id, ids)`` of every row, or ``(id, n_tokens)``.

    An empty and a null text both have the empty list (0 tokens) and keep their row.
    No special tokens are added, and their strings in a text are ordinary text. Rows
    with equal or null ids keep a row each. Further columns are pruned. A text is
    never divided between blocks. Empty tables give no rows.
    """
    path, pat = vocabulary or default_vocabulary(), pattern or default_pattern()
    cut = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _cut(it, pat), CUT)
    spark = df.sparkSession
    spark.sparkContext.addFile(path)
    space = Workspace(spark, "tokens")
    cut = space.save(cut)
    texts = cut.filter("numbers IS NOT NULL").select("block", "id", "numbers", F.col("word_no").alias("n_words"))
    words = cut.filter("word IS NOT NULL").select("block", "word_no", "word")
    known = space.save(words.groupBy("word").agg(F.count(F.lit(1)).alias("n_blocks")).mapInArrow(lambda it: _encode(it, path, pat), "word binary, n_blocks long, ids array<int>"))
    common = F.col("n_blocks") >= max(common_blocks, (known.agg(F.sum("n_blocks")).first()[0] or 0) // COMMON_WORDS)
    marked = words.join(F.broadcast(known.filter(common).select("word", F.col("ids").alias("common"))), "word", "left")
    rare = marked.filter("common IS NULL").join(known.filter(~common).select("word", "ids"), "word")
    back = marked.filter("common IS NOT NULL").select("block", "word_no", F.col("common").alias("ids")).unionByName(rare.select("block", "word_no", "ids"))
    back = back.withColumnRenamed("block", "of_block")
    schema = "id long, n_tokens long" if count_only else "id long, ids array<int>"
    out = texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(lambda a, b: _assemble(a, b, count_only), schema)
    return out.withColumnRenamed("id", id)


def decode_corpus(df: DataFrame, id: str, ids: str, *, vocabulary: str | None = None) -> DataFrame:
    """``(id, text)``: tokens joined with the token-byte table and put together by position.

    Null ids give a null text and no ids an empty one; an id that the vocabulary lacks,
    or a null within the ids, raises an error. Bytes that are no UTF-8 become the
    replacement character. Rows with equal ids keep a text each.
    """
    spark = df.sparkSession
    table = ranks(vocabulary or default_vocabulary())
    tokens = spark.createDataFrame(pa.table({"token": pa.array(table.values(), pa.int32()), "bytes": pa.array([b.hex() for b in table], pa.string())}))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(ids).alias("ids"))
    rows = rows.select("row", "id", F.col("ids").isNull().alias("none"), F.posexplode_outer("ids").alias("pos", "token"))
    known = rows.join(F.broadcast(tokens), "token", "left")
    piece = F.when(F.col("pos").isNull(), F.lit("")).otherwise(F.coalesce("bytes", F.raise_error(F.concat(F.lit("no token "), F.coalesce(F.col("token").cast("string"), F.lit("null"))))))
    whole = known.groupBy("row", "id", "none").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("bytes")))).alias("p"))
    text = F.make_valid_utf8(F.unhex(F.array_join("p.bytes", "")).cast("string"))
    return whole.select(F.col("id").alias(id), F.when(~F.col("none"), text).alias("text"))

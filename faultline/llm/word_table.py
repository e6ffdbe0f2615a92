"""Encoding through a table of distinct words, for tokenizers whose words are encoded on their own.

Method
    1. Texts are split into the tokenizer's words (pieces that merges never cross) in blocks of ``BLOCK_CHARS``
       characters. A block keeps, for each document, the numbers of its words in the block's list of distinct words.
    2. The lists are dealt by a hash of the word, so that all blocks' requests for a word meet in one partition,
       where it is encoded once; the ids go back under the word's number. What is dealt is packed: one row for
       each block and partition, so a common word costs an entry a block, not an entry an occurrence.
    3. Each block gets its ids back, joins them to its documents by word position, and decodes by a join of ids to
       the table of pieces.
    No step gathers more than a block or a partition's distinct words, and nothing is broadcast but the tokenizer.

A tokenizer is a class, made from the path of its file, with

* ``split(text)``: its words, which make up the text that is decoded;
* ``encode(words)``: a list of ids for each;
* ``pieces()``: starts and lengths of the ids' pieces in one string of bytes;
* ``digits()``: starts and lengths of what an id adds to the digest of ids, and the string of bytes that holds it;
* ``finish(ids, text)``, a static method: what a document's digits and pieces, each joined, become.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._memory import release, released
from faultline.llm._store import bounded_batches, stored

BLOCK_CHARS = 4_000_000
#: Words that go to the tokenizer at once.
ENCODED_AT_ONCE = 1000
#: Bytes of input for each partition of distinct words; a plan that says it has more than UNKNOWN_BYTES doesn't know.
PARTITION_BYTES, UNKNOWN_BYTES = 128 << 20, 1 << 50
#: Steps of a plan after which rows may be dealt otherwise when it is run again.
_MOVED = re.compile(r"(?i)Aggregate|Join|Repartition|Sort|Window|Limit|MapIn|Sample|Deduplicate|rand\(|uuid\(")


@lru_cache(2)
def _made(kind: type, path: str):
    return kind(path)


@lru_cache(2)
def _tables(kind: type, path: str):
    """A tokenizer's digits and pieces, which are small, without what else its class holds."""
    made = kind(path)
    out = made.digits(), made.pieces()
    del made
    release()
    return out


def _forgetting(run):
    """``run`` for mapInArrow, after which the worker, which outlives its task, holds no tokenizer but one that its class keeps for itself."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _made.cache_clear()

    return released(wrapped)


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


# Rows between the steps: part -1 is a block's documents, others are its words for one partition. Both kinds come from
# a reading of their own, of input whose partitions are fixed (else it is stored first); check, a checksum of the block's
# words by position, ends the job should the two differ all the same.
BLOCKS = "block long, check long, part int, doc_id array<long>, n_words binary, body binary, lengths binary"


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _split(kind: type, path: str, parts: int, documents: bool):
    """Blocks' documents, or the words for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = _made(kind, path).split, 0
        base = TaskContext.get().partitionId() << 32

        def flush(ids, numbers, table):
            nonlocal count
            words = [w.encode("utf-8") for w in table]
            body = np.concatenate([np.zeros(0, np.uint32), *numbers])
            key = (base | count, zlib.crc32(b"\0".join(words), zlib.crc32(body.tobytes())))
            if documents:
                rows = [(*key, -1, ids, pack(np.array([*map(len, numbers)], np.uint32)), pack(body), None)]
            else:
                where = np.array([zlib.crc32(w) % parts for w in words], np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(parts + 1))
                rows = []
                for p in range(parts):
                    at = order[cuts[p] : cuts[p + 1]]
                    if len(at):
                        own = [words[i] for i in at]
                        rows.append((*key, p, None, pack(at), zstandard.compress(b"".join(own), 1), pack(np.array([*map(len, own)]))))
            count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * 7, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], ["block", "check", "part", "doc_id", "n_words", "body", "lengths"])

        ids, numbers, table, chars = [], [], _Numbers(), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if chars and chars + len(text) > BLOCK_CHARS:
                    yield flush(ids, numbers, table)
                    ids, numbers, table, chars = [], [], _Numbers(), 0
                words = split(text)
                numbers.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
                ids.append(i)
                chars += len(text)
        if ids:
            yield flush(ids, numbers, table)

    return run


def _cut(body: bytes, lengths: np.ndarray) -> list[str]:
    out, at = [], 0
    for n in lengths.tolist():
        out.append(body[at : at + n].decode("utf-8"))
        at += n
    return out


def _encode(kind: type, path: str):
    """Words to ids, each distinct word of the partition once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _made(kind, path), {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = _cut(zstandard.decompress(r["body"]), unpack(r["lengths"]))
                new = [w for w in words if w not in known]
                # A few at a time, since what a library says of a word is much larger than its ids.
                for i in range(0, len(new), ENCODED_AT_ONCE):
                    few = new[i : i + ENCODED_AT_ONCE]
                    for w, ids in zip(few, tokenizer.encode(few)):
                        known[w] = np.array(ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                rows.append((r["block"], r["check"], r["n_words"], pack(np.frombuffer(b"".join(ids), "<u4")), pack(np.array([*map(len, ids)]) // 4)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "check", "n_words", "body", "lengths"])

    return run


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _by_word(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: bytes) -> list[bytes]:
    """What each word's ids stand for: ids up to ``ends``, joined to their places in ``data``."""
    joined = np.frombuffer(data, np.uint8)[ranges(starts[ids], lengths[ids])].tobytes()
    cuts = np.concatenate(([0], np.cumsum(lengths[ids])))[np.concatenate(([0], ends))].tolist()
    return [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _assemble(kind: type, path: str, texts: bool):
    """A block's documents and its words' ids, joined by position; then ids to pieces."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        at, flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        if len({*docs.column("check").to_pylist(), *words.column("check").to_pylist()}) > 1:
            raise RuntimeError("the documents differed between two readings; store them before encoding")
        for r in words.to_pylist():
            at.append(unpack(r["n_words"]))
            flat.append(unpack(r["body"]))
            lengths.append(unpack(r["lengths"]))
        # The words come by partition; what they have is put in order of their numbers.
        at, flat, lengths = np.concatenate(at), np.concatenate(flat), np.concatenate(lengths).astype(np.int64)
        order = np.argsort(at)
        flat, lengths = flat[ranges((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]
        ends = np.cumsum(lengths)
        digits, pieces = (_by_word(flat, ends, *t) for t in _tables(kind, path))
        out = []
        for r in docs.to_pylist():
            n_words, body = unpack(r["n_words"]).astype(np.int64), unpack(r["body"])
            stops = np.cumsum(n_words)
            for doc_id, low, high in zip(r["doc_id"], (stops - n_words).tolist(), stops.tolist()):
                w = body[low:high]
                numbers = w.tolist()
                ids, text = kind.finish(b"".join(map(digits.__getitem__, numbers)), b"".join(map(pieces.__getitem__, numbers)))
                row = (doc_id, int(lengths[w].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest())
                out.append((*row, flat[ranges((ends - lengths)[w], lengths[w])].tolist(), text) if texts else row)
        kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())][: 6 if texts else 4]
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], [n for n, _ in kinds]) if out else pa.schema(kinds).empty_table()

    return run


def through_words(docs: DataFrame, kind: type, path: str, partitions: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``; with ``texts`` also ids and decoded.

    ``kind`` is the tokenizer's class and ``path`` its file, at the same place on every executor. ``partitions`` of
    distinct words: by default the session's shuffle partitions, and one for every ``PARTITION_BYTES`` of a larger input.
    Input that is read differently a second time, which its plan does not tell, ends the job.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = source._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    parts = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES if size < UNKNOWN_BYTES else 0)
    if _MOVED.search(plan.toString()):
        # Both readings are to see the same partitions.
        source = stored(source, "word-table-documents")
    blocks = source.mapInArrow(_forgetting(_split(kind, path, parts, documents=True)), BLOCKS)
    words = source.mapInArrow(_forgetting(_split(kind, path, parts, documents=False)), BLOCKS).select("block", "check", "part", "n_words", "body", "lengths")
    words = words.repartitionById(parts, "part").mapInArrow(_forgetting(_encode(kind, path)), "block long, check long, n_words binary, body binary, lengths binary")
    out = ENCODED + (", ids array<int>, decoded string" if texts else "")
    return blocks.select("block", "check", "doc_id", "n_words", "body").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_assemble(kind, path, texts), out)

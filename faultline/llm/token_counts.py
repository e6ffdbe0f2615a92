"""Token counts by section, attributed through token offsets.

Method
    A document is encoded whole, once. Tokens of a byte-level vocabulary have the bytes of the text in order, so the
    running sum of their lengths gives each token's span; an interval join of the spans to those of the sections (the
    lines of a text, or the fields of a record) counts each section's tokens. Tokens that cross a boundary go by
    an explicit rule:

    ``start``         to the section in which the token starts
    ``largest``       to the section with most of its bytes, the earlier one of equals
    ``proportional``  to every section it touches, in shares by bytes

    and a token, or share, that is in no section is counted under section -1. So the counts of a document add up to its
    tokens under any rule. Document and sections are in one task; nothing is shuffled.

Cases
    Null or empty text: section -1 with 0 tokens, and no other. Empty lines are sections without tokens. Rows are
    independent, so repeated rows and null doc_ids are counted row by row; an empty table gives no rows. Texts are
    encoded whole. Strings of special tokens are ordinary text. Columns other than those named are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._store import bounded_batches
from faultline.llm._text import utf8

RULES = ("start", "largest", "proportional")
#: The pattern that splits text before the merges (a fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file and the bytes in each token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section, and of none as the last element.

    ``lengths`` are the tokens' bytes; sections are half-open byte ranges in order that do not overlap.
    """
    n = len(starts)
    stop = np.cumsum(lengths)
    start = stop - lengths
    counts, crossing = np.zeros(n + 1), np.zeros(n + 1)
    if not len(lengths):
        return counts, crossing
    # The sections a token may touch: from the first that ends after it starts to the last that starts before it stops.
    # Empty sections touch nothing.
    low, high = np.searchsorted(ends, start, "right"), np.searchsorted(starts, stop, "left") - 1
    inside = (low == high) & (low < n)
    inside[inside] &= (starts[low[inside]] <= start[inside]) & (stop[inside] <= ends[low[inside]])
    counts += np.bincount(low[inside], minlength=n + 1)
    outside = high < low
    counts[n] += np.count_nonzero(outside)
    for t in np.flatnonzero(~inside & ~outside):
        a, b, size = int(start[t]), int(stop[t]), int(lengths[t])
        touched = [(s, min(b, int(ends[s])) - max(a, int(starts[s]))) for s in range(int(low[t]), int(high[t]) + 1)]
        touched = [(s, w) for s, w in touched if w > 0]
        if not touched:
            counts[n] += 1
            continue
        for s, _ in touched:
            crossing[s] += 1
        if rule == "start":
            first = touched[0][0]
            counts[first if starts[first] <= a else n] += 1
        elif rule == "largest":
            counts[max(touched, key=lambda x: (x[1], -x[0]))[0]] += 1
        else:
            for s, w in touched:
                counts[s] += w / size
            counts[n] += 1 - sum(w for _, w in touched) / size
    return counts, crossing


SECTIONS = "section int, start long, end long, n_tokens double, n_crossing long"


def _rows(ids: pa.Array, records: list[tuple[bytes, np.ndarray, np.ndarray]], path: str, rule: str) -> pa.RecordBatch:
    """Section rows of records of (utf-8 text, starts, ends); offsets are turned to code points."""
    encoding, sizes = _encoding(path)
    index, out = [], [[] for _ in range(5)]
    for i, (raw, starts, ends) in enumerate(records):
        tokens = np.asarray(encoding.encode_to_numpy(raw.decode("utf-8"), disallowed_special=()), np.int64) if raw else np.zeros(0, np.int64)
        counts, crossing = attribute(sizes[tokens], starts, ends, rule)
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        n = len(starts)
        index += [i] * (n + 1)
        for column, values in zip(out, ([*range(n), -1], [*points[starts].tolist(), None], [*points[ends].tolist(), None], counts.tolist(), crossing.astype(int).tolist())):
            column += values
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", *(c.split()[0] for c in SECTIONS.split(", "))])


def line_token_counts(docs: DataFrame, path: str, rule: str = "largest") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for each line of each text, and section -1."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            records = []
            for low, high in zip(offsets[:-1], offsets[1:]):
                raw = data[low:high]
                breaks = np.flatnonzero(raw == 10)
                if len(raw):
                    records.append((raw.tobytes(), np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))))
                else:
                    records.append((b"", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            yield _rows(batch.column(0), records, path, rule)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + SECTIONS)


def field_token_counts(docs: DataFrame, fields: list[str], path: str, separator: str = "\n", rule: str = "largest") -> DataFrame:
    """(doc_id, section, ...) for each of ``fields``, numbered in order, of records encoded as the fields joined by ``separator``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    gap = separator.encode()

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for values in zip(*(c.to_pylist() for c in batch.columns[1:])):
                parts = [(v or "").encode() for v in values]
                sizes = np.array([*map(len, parts)], np.int64)
                starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
                records.append((gap.join(parts), starts, starts + sizes))
            yield _rows(batch.column(0), records, path, rule)

    columns = [F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).mapInArrow(run, "doc_id long, " + SECTIONS)

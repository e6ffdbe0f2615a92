"""SentencePiece encoding and decoding through a table of distinct chunks (:mod:`faultline.llm.word_table`).

Method
    Spaces become markers, and a text is cut before every run of markers: into the run and what follows it up to the
    next one. No piece of the model holds a marker after another character (this is checked when the model is read), so
    no merge crosses a cut, and each distinct chunk is segmented once, by the library. Ids are joined back by position,
    and joined to the table of pieces to decode.

The model must be of the kind whose normalizer leaves text as it is but for the marker that it puts before it, and that
falls back to bytes; other models are refused. A chunk is given to the library without its first marker, which the
library puts before it; a marker alone is its own piece.

Cases
    Null text reads as empty: no tokens, hashes of nothing. Empty table: no rows. Repeated rows and null doc_ids are
    encoded row by row. Very long texts make a block of their own, and a text without spaces is one chunk. A marker in
    the text itself reads as a space and is decoded as one. Names of control pieces in a text are ordinary text. Other
    columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from faultline.llm.word_table import through_words

MARK = "\u2581"
#: Texts that tell whether the model's normalizer leaves text as it is.
_PLAIN = ["a", " a", "a  b ", "\t A\u0301 \uff21\u00a0\r\n b", "\u200bx \u00bd"]


class SentencePieces:
    """The chunks, ids and pieces of a model file."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        ordinary = [p for i, p in enumerate(self.names) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(p) for p in ordinary):
            raise ValueError("the model has pieces that go over a marker")
        if MARK not in ordinary or any(m.decode(m.encode(t)) != t for t in _PLAIN) or any(map(m.is_unused, range(len(self.names)))):
            raise ValueError("the model does not leave text as it is")
        self.chunks = re.compile(" *[^ ]+| +").findall
        self.mark = [m.piece_to_id(MARK)]

    def split(self, text: str) -> list[str]:
        """Chunks, with a space for each marker."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text or text[-1] == " ":
            return self.chunks(text)
        return [" " + w for w in text[1:].split(" ")]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [ids if c != " " else self.mark for c, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1))]

    def pieces(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Starts and lengths of the ids' pieces in one string of bytes, with a space for each marker."""
        m, pieces = self.model, []
        for i, p in enumerate(self.names):
            pieces.append(b"" if m.is_control(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode("utf-8"))
        lengths = np.array([*map(len, pieces)], np.int64)
        return np.cumsum(lengths) - lengths, lengths, b"".join(pieces)

    def digits(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """An id adds its decimal digits and a comma to the digest."""
        digits = [b"%d," % i for i in range(len(self.names))]
        lengths = np.array([*map(len, digits)], np.int64)
        return np.cumsum(lengths) - lengths, lengths, b"".join(digits)

    @staticmethod
    def finish(ids: bytes, text: bytes) -> tuple[bytes, str]:
        """Without the last comma, and without the marker that the library put first."""
        return ids[:-1], text[1:].decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, partitions: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``; with ``texts`` also ids and decoded.

    ids_sha256 is of the decimal ids, joined by commas. ``path`` is the model file, at the same place on every executor.
    ``partitions`` of distinct chunks: by default the session's shuffle partitions, and one for every 128 MB of a larger
    input.
    """
    return through_words(docs, SentencePieces, path, partitions, texts)

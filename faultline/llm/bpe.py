"""BPE encoding and decoding through a table of distinct words (:mod:`faultline.llm.word_table`).

Method
    Texts are split into the words that merges never cross, each distinct word is encoded once, ids are joined back by
    position, and ids are joined to the table of pieces to decode.

Splitting follows the byte-level pattern of the vocabulary file; texts with characters beyond U+024F, about whose
classes Unicode versions differ, are split by the library itself. The added token of the file is one word.

Cases
    Null text reads as empty: no tokens, hashes of nothing. Empty table: no rows. Repeated rows and null doc_ids are
    encoded row by row. Very long texts make a block of their own. Other columns are ignored. Input that two readings
    give differently, though its plan moves no rows, is an error.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faultline.llm.word_table import through_words

#: Letters, numbers and white space up to U+024F.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The pattern that splits text before the merges (a fixed value of the vocabulary's format), for text of such characters.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
_EXOTIC = re.compile("[^\x00-ɏ]")


@lru_cache(2)
def _library(path: str) -> Tokenizer:
    """The library's tokenizer, made once a process.

    The library keeps what it has encoded by tokenizer and thread, and a tokenizer that goes leaves that behind. So one
    stays, and it encodes in the calling thread alone.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteBpe:
    """The words, ids and pieces of a tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = _library(path)
        self.find = re.compile(PATTERN).findall
        self.by_id = {i: a.content for i, a in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {*self.by_id.values()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and _EXOTIC.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def split(self, text: str) -> list[str]:
        if self.parts is None or not any(a in text for a in self.added):
            return self._plain(text)
        return [w for part in self.parts.split(text) if part for w in ([part] if part in self.added else self._plain(part))]

    def encode(self, words: list[str]) -> list[list[int]]:
        # One by one: a batch is dealt to a thread for each of the machine's cores.
        return [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]

    def _size(self) -> int:
        return max([*self.tokenizer.get_vocab(True).values()]) + 1

    def pieces(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Starts and lengths of the ids' pieces in one string of bytes; an added token's piece is its text."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        pieces = [b""] * self._size()
        for piece, i in self.tokenizer.get_vocab(True).items():
            pieces[i] = self.by_id[i].encode() if i in self.by_id else bytes(back[c] for c in piece)
        lengths = np.array([*map(len, pieces)], np.int64)
        return np.cumsum(lengths) - lengths, lengths, b"".join(pieces)

    def digits(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """An id adds four bytes to the digest."""
        n = self._size()
        return np.arange(n) * 4, np.full(n, 4), np.arange(n, dtype="<u4").tobytes()

    @staticmethod
    def finish(ids: bytes, text: bytes) -> tuple[bytes, str]:
        return ids, text.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, partitions: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``; with ``texts`` also ids and decoded.

    ``path`` is the vocabulary file, at the same place on every executor. ``partitions`` of distinct words: by
    default the session's shuffle partitions, and one for every 128 MB of a larger input.
    """
    return through_words(docs, ByteBpe, path, partitions, texts)

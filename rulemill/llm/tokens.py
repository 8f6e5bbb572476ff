"""Encoding whole texts with a public tokenizer, piece by piece.

A piece is text between two places where the tokenizer can join nothing: its ids do not depend on its neighbours. Pieces
recur, so a batch of texts is cut into pieces by Arrow, each distinct piece is encoded once, and the ids of a text are
gathered from those of its pieces. Codes of pieces are kept in a bounded cache.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in each of the two generations of a worker's cache.
CACHE_PIECES = 150_000
#: Bytes of text that are encoded at once, unless one text is longer.
BATCH_BYTES = 2 << 20

#: White space other than blanks and line feeds, and the mark used for cutting.
_ODD_SPACE = "[\x00\x01\t\r\x0b\x0c\x1c-\x1f\u0085   -     　]"
#: Bytes with which such a space begins in UTF-8.
_ODD_BYTE = np.isin(np.arange(256), [c.encode()[0] for c in _ODD_SPACE[1:-1] if c != "-"] + [*range(0x1C, 0x20)])
_SOLID_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A word of Latin-1 letters and marks after it, which every tokenizer here encodes apart.
_MARKS = ".,!?;:|#*$%&"
_WORD = re.compile(rf"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([{_MARKS}]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level encoding writes for each byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids equal to those of encode(text, add_special_tokens=False) for each whole text."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_pieces
        #: Byte-level encoding keeps the blank before a word; the other kind drops white space and folds case.
        self.keeps_blanks = self.tokenizer.normalizer is None
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if not self.keeps_blanks:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
        return pc.split_pattern(marked, "\x01")

    def _is_odd(self, texts: pa.Array) -> pa.Array:
        """Texts with runs of white space, which a byte-level pattern may cut elsewhere."""
        if not self.keeps_blanks:
            return pa.array(np.zeros(len(texts), bool))
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        gap = (raw == 32) | (raw == 10)
        marks = np.flatnonzero(gap[1:] & gap[:-1])
        # two gaps side by side in one text; the others are looked at only where a byte of an odd space occurs
        runs = np.searchsorted(marks, bounds[1:] - 1) > np.searchsorted(marks, bounds[:-1])
        leads = np.flatnonzero(_ODD_BYTE[raw])
        some = np.flatnonzero((np.searchsorted(leads, bounds[1:]) > np.searchsorted(leads, bounds[:-1])) & ~runs)
        runs[some] = pc.match_substring_regex(texts.take(pa.array(some)), _ODD_SPACE).to_numpy(zero_copy_only=False)
        return pa.array(runs)

    def code(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                found = self._fresh(piece)
            if len(self.known) >= self.limit:
                self.known, self.older = {}, self.known
            self.known[piece] = found
        return found

    def _fresh(self, piece: str) -> bytes:
        stem = piece.rstrip(_MARKS)
        blank = stem[:1] == " "
        body = stem[1:] if blank else stem
        if body.isascii() and body.isalpha():  # a word whose letters stand for themselves, without a pattern's cost
            if len(stem) < len(piece):
                return self.code(stem) + self.code(piece[len(stem) :])
            return self._word((self.letters[32] if blank else "") + body if self.keeps_blanks else body.lower())
        word = _WORD.fullmatch(piece)
        if word and word[2]:
            return self.code(word[1]) + self.code(word[2])
        if not word:
            return _little(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        text = piece.encode().decode("latin-1") if self.keeps_blanks else piece.strip(" ").lower().encode().decode("latin-1")
        return self._word(text.translate(self.letters))

    def _word(self, letters: str) -> bytes:
        return _little([t.id for t in self.tokenizer.model.tokenize(letters)])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text ends. NULL texts are empty; the end id closes each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = self._is_odd(texts)
        plain = pc.if_else(odd, "", texts)
        cut = self._cut(plain)
        offsets, pieces = cut.offsets.to_numpy().astype(np.int64), pc.dictionary_encode(cut.flatten())
        codes = [self.code(p) for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        which = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        extra = [b"".join(map(self.code, _SOLID_CUT.split(texts[i].as_py()))) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))]
        # an odd text is one piece of its own, and the end id is the last piece of every text
        tail = np.full(len(texts), -1, np.int64)
        tail[np.flatnonzero(odd.to_numpy(zero_copy_only=False))] = len(codes) + np.arange(len(extra))
        close = len(codes) + len(extra)
        codes += [*extra, b"" if end_id is None else _little([end_id])]
        none = len(codes)
        codes.append(b"")
        tail[tail < 0] = none
        which = np.insert(which, np.repeat(offsets[1:], 2), np.stack([tail, np.full(len(texts), close)], 1).ravel())
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        ids, done = chosen_runs(np.frombuffer(b"".join(codes), "<u4"), sizes, which)
        last = offsets[1:] + 2 * np.arange(1, len(texts) + 1) - 1
        return ids, done[last] if len(texts) else np.zeros(0, np.int64)


def chosen_runs(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, given one after the other with their sizes -> those of the numbers `which`, one after the other, and where each ends."""
    bounds = 4 * np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    runs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])
    chosen = runs.take(pa.array(which))
    ends = np.frombuffer(chosen.buffers()[1], np.int64, len(which) + 1, 8 * chosen.offset) // 4
    return np.frombuffer(chosen.buffers()[2] or b"", "<u4", int(ends[-1])), ends[1:]


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise TypeError("unsigned int does not have four bytes here")
    return out.tobytes()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder for a worker process, kept from task to task."""
    if (path, cache_pieces) not in _ENCODERS:
        _ENCODERS[path, cache_pieces] = Encoder(path, cache_pieces)
    return _ENCODERS[path, cache_pieces]


def _gathered(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold `batch_bytes`."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= batch_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, cache_pieces: int = CACHE_PIECES, batch_bytes: int = BATCH_BYTES
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Batches of (id, text) -> (ids of documents, token ids, where each document ends), a bounded amount of text at a time."""
    codec = encoder(path, cache_pieces)
    for batch in _gathered(batches, batch_bytes):
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // batch_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield (batch.column(0).slice(a, b - a).to_pylist(), *codec.encode(batch.column(1).slice(a, b - a), end_id))
    pa.default_memory_pool().release_unused()  # the worker lives on beside later tasks

"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of `least` tokens are tiled: the longest match of tokens that no tile covers
yet is marked, again and again, until no match of `least` tokens is left. An item leaked if tiles cover enough of it, in
whatever order its parts stand in the document. Matches of one length are found by Karp-Rabin hashes of all windows at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import bounded_batches, id_and_text, map_rows

#: Shortest tile in tokens, and the least covered share of an item.
LEAST, THRESHOLD = 5, 0.8
#: Benchmark text that is indexed and sent to the tasks at once; a larger benchmark is read in so many blocks.
BLOCK_BYTES = 8 << 20

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if n > len(_POWERS.get("up", ())):
        size = max(1024, 2 * n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` ids, from prefix sums."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(ids) + 1)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(29)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(ids)], dtype=np.uint64)))
    return (prefix[size:] - prefix[:-size]) * down[: len(ids) - size + 1]


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(item position, doc position) of equal windows without a marked token."""
    whole = lambda free: np.flatnonzero(np.convolve(free, np.ones(size, np.int64), "valid") == size) if len(free) >= size else []
    at_doc, at_item = whole(free_doc), whole(free_item)
    if not len(at_doc) or not len(at_item):
        return []
    places: dict[int, list[int]] = {}
    for i, h in zip(at_item.tolist(), rolling(item, size)[at_item].tolist()):
        places.setdefault(h, []).append(i)
    return sorted(
        (i, d) for d, h in zip(at_doc.tolist(), rolling(doc, size)[at_doc].tolist()) for i in places.get(h, ()) if (doc[d : d + size] == item[i : i + size]).all()
    )


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length), longest first; of equal length the first in the item, then in the document. Token ids below 0 match nothing."""
    free_doc, free_item, out = (doc >= 0).astype(np.int64), (item >= 0).astype(np.int64), []
    size = len(item)
    while size >= least:
        found = _matches(doc, item, free_doc, free_item, size)
        if not found:
            # the longest match that is left: a match of some length holds one of every shorter length
            low, high = least - 1, size - 1
            while low < high:
                middle = (low + high + 1) // 2
                if _matches(doc, item, free_doc, free_item, middle):
                    low = middle
                else:
                    high = middle - 1
            size = low
            if size < least:
                break
            found = _matches(doc, item, free_doc, free_item, size)
        for i, d in found:
            if free_item[i : i + size].all() and free_doc[d : d + size].all():
                free_item[i : i + size] = free_doc[d : d + size] = 0
                out.append((i, d, size))
        size -= 1
    return out


class Index:
    """Seeds of a block of benchmark items: every window of `least` tokens."""

    def __init__(self, items: list[tuple], least: int = LEAST):
        self.least, self.names, self.words, self.items = least, [], {}, []
        seeds, owners, places = [], [], []
        for name, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in tokens(text)], np.int64)
            if len(ids) >= least:
                hashes = rolling(ids, least)
                seeds.append(hashes)
                owners.append(np.full(len(hashes), len(self.items)))
                places.append(np.arange(len(hashes)))
                self.names.append(name)
                self.items.append(ids)
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owners = np.concatenate(owners)[order] if seeds else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if seeds else np.zeros(0, np.int64)

    def leaks(self, text: str | None, threshold: float) -> Iterator[tuple]:
        """(item name, coverage, tiles) for every item of which tiles cover the threshold."""
        if not len(self.seeds):
            return
        doc = np.fromiter(map(self.words.get, tokens(text), repeat(-1)), np.int64)
        known = doc >= 0
        if len(doc) < self.least:
            return
        count = np.cumsum(np.concatenate(([0], known)))
        at = np.flatnonzero(count[self.least :] - count[: -self.least] == self.least)
        if not len(at):
            return
        hashes = rolling(doc, self.least)[at]
        low = np.searchsorted(self.seeds, hashes, "left")
        hit = self.seeds[np.minimum(low, len(self.seeds) - 1)] == hashes
        if not hit.any():
            return
        met, high = np.unique(hashes[hit]), None
        low, high = np.searchsorted(self.seeds, met, "left"), np.searchsorted(self.seeds, met, "right")
        which = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())])
        by_item: dict[int, list[int]] = {}
        for item, place in zip(self.owners[which].tolist(), self.places[which].tolist()):
            by_item.setdefault(item, []).append(place)
        for item, starts in sorted(by_item.items()):
            ids = self.items[item]
            bound = np.zeros(len(ids), bool)
            for p in starts:
                bound[p : p + self.least] = True
            if bound.sum() < threshold * len(ids):  # tiles consist of seeds, so they cannot cover more
                continue
            # only stretches of the document that hold seeds of this item
            own = np.isin(hashes, rolling(ids, self.least))
            near = np.zeros(len(doc) + 1, np.int64)
            np.add.at(near, at[own], 1)
            np.add.at(near, at[own] + self.least, -1)
            inside = np.cumsum(near)[:-1] > 0
            keep = inside | np.concatenate(([False], inside[:-1]))  # one token apart keeps stretches apart
            places = np.flatnonzero(keep)
            short = np.where(inside, doc, -1)[places]
            tiles = tile(short, ids, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(ids):
                yield self.names[item], covered / len(ids), [(i, int(places[d]), n) for i, d, n in tiles]


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items, in blocks of about `block_bytes` of text; nothing is left out, and one block at a time is on the driver."""
    items = benchmark.select(column(id_column).alias("item_id"), column(text_column).cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) for every document and item of which tiles cover at least `threshold`.

    Tokens are runs of letters, digits and underscores in lower case. A NULL or short text and an item of fewer than `least` tokens
    match nothing; repeated rows of either table are matched each. The documents are read once for each block of the
    benchmark and never shuffled. The item id comes back as text. An empty table gives an empty result.
    """
    schema = "doc_id long, item_id string, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"
    out = None
    for block in _blocks(benchmark, item_column, item_text, block_bytes):
        index = Index([(None if name is None else str(name), text) for name, text in block], least)

        def rows(texts: Iterator[tuple], index=index) -> Iterator[tuple]:
            for doc_id, text in texts:
                for name, coverage, tiles in index.leaks((text or b"").decode("utf-8", "replace"), threshold):
                    yield doc_id, name, coverage, [dict(zip(("item_start", "doc_start", "length"), t)) for t in tiles]

        found = map_rows(id_and_text(docs, id_column, text_column), rows, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text holds no leaked item, with all their columns. One narrow pass for each block of the benchmark."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_column)
    for block in _blocks(benchmark, "item_id", "text", block_bytes):
        index = Index(block, least)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(index.leaks(text, threshold), None) is None for text in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

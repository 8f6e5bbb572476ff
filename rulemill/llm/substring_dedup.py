"""Long passages that an earlier document already holds, by compaction of a de Bruijn graph.

Edges of the graph are the windows of `window` consecutive words. Each window has a landmark, the k-mer with the smallest hash
in it; the consecutive windows of a document that share a landmark form a path, which is stored as one row: the hash of
the landmark, the hash of all words the path spans, and its place in the document. Equal windows have equal landmarks, so
paths only have to meet paths of the same landmark. Where all of them span the same words the path does not branch, and
one comparison decides for all its windows; where they differ, the windows themselves are compared. Both end in source
coordinates, the word ranges that leave each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from rulemill.llm.common import as_batch, id_and_text, schema_of, written

WINDOW, KMER = 50, 16

_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_KNOWN: dict[bytes, int] = {}
_KNOWN_WORDS = 400_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every word; those of recent words are remembered."""
    if len(_KNOWN) > _KNOWN_WORDS:
        _KNOWN.clear()
    get, out = _KNOWN.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    known = _POWERS.get((which, inverse))
    if known is None or len(known) < n:
        steps = np.full(max(4096, 2 * n), pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which], np.uint64)
        steps[0] = 1
        known = _POWERS[which, inverse] = np.multiply.accumulate(steps)
    return known


class Spans:
    """Hashes of any word range of a document, two independent ones of 64 bits."""

    def __init__(self, words: list[bytes]):
        base = word_hashes(words)
        self.prefix = []
        for which in (0, 1):
            own = _mixed(base + np.uint64(which)) * _powers(which, False, len(words) + 1)[: len(words)]
            self.prefix.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64))))

    def hash(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        down = _powers(which, True, len(self.prefix[which]))
        return _mixed((self.prefix[which][stop] - self.prefix[which][start]) * down[start] + (stop - start).astype(np.uint64))


def paths(spans: Spans, n_words: int, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(landmark hash, hash of the spanned words with the landmark's place, first window, number of windows) of each path."""
    n = n_words - window + 1
    at = np.arange(n_words - kmer + 1)
    marks = spans.hash(0, at, at + kmer)
    reach = window - kmer + 1
    # the leftmost smallest k-mer of every window
    place = np.argmin(np.lib.stride_tricks.sliding_window_view(marks, reach), 1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, n))
    context = spans.hash(1, first, first + count + window - 1) + _mixed((place[first] - first).astype(np.uint64))
    return marks[place[first]], context, first, count


def _path_rows(window: int, kmer: int, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in types]
            for doc_id, text, version in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or b"").split()
                if doc_id is None or len(words) < window:
                    continue
                mark, context, first, count = paths(Spans(words), len(words), window, kmer)
                for c, values in zip(columns, (mark.view(np.int64), context.view(np.int64), np.full(len(first), doc_id), np.full(len(first), version), first, count)):
                    c.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type, safe=False) for c, f in zip(columns, types)], schema=types)

    return run


def _window_rows(window: int, types: pa.Schema):
    """(doc_id, version, packed text, branching paths) -> the windows of these paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in types]
            for doc_id, version, packed, todo in zip(*(c.to_pylist() for c in batch.columns)):
                spans = Spans(unpack.decompress(packed).split())
                at = np.concatenate([np.arange(p["first"], p["first"] + p["count"]) for p in todo])
                one, two = spans.hash(0, at, at + window), spans.hash(1, at, at + window)
                for c, values in zip(columns, (one.view(np.int64), two.view(np.int64), np.full(len(at), doc_id), np.full(len(at), version), at)):
                    c.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type, safe=False) for c, f in zip(columns, types)], schema=types)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], names=["doc_id", "packed", "version"])


def repeated_spans(docs: DataFrame, packed: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, version, first, count): runs of windows whose words also start in a document with a smaller id."""
    spark = docs.sparkSession
    rows = "mark long, context long, doc_id long, version long, first int, count int"
    every = written(docs.mapInArrow(_path_rows(window, kmer, schema_of(spark, rows)), rows), "dedup-paths")

    # which landmarks stand in several documents, and whether their paths branch; minima are combined before the shuffle
    marks = every.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("context").alias("low"), F.max("context").alias("high"))
    marks = written(marks.filter("least < most").selectExpr("mark", "least", "low <> high AS branches"), "dedup-marks")
    met = every.join(marks, "mark").filter("branches OR doc_id > least").select("doc_id", "version", "first", "count", "branches")
    met = written(met, "dedup-met")

    straight = met.filter("NOT branches").select("doc_id", "version", "first", "count")
    todo = met.filter("branches").groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "count")).alias("todo"))
    shape = "one long, two long, doc_id long, version long, first int"
    todo = packed.join(todo, ["doc_id", "version"]).select("doc_id", "version", "packed", "todo")
    windows = todo.mapInArrow(_window_rows(window, schema_of(spark, shape)), shape)
    windows = written(windows, "dedup-windows")
    least = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("one", "two", "least")
    least = written(least, "dedup-least")
    single = windows.join(least, ["one", "two"]).filter("doc_id > least").select("doc_id", "version", "first", F.lit(1).alias("count"))
    return straight.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: the words that no repeated window covers, joined by one blank, as UTF-8 bytes.

    A word is removed if a window of `window` words over it also starts in a document with a smaller id; windows are those of
    the input. A NULL text has no words. Rows with a NULL id repeat nothing and are kept whole. Rows that share an id count as one
    source: they are not compared with each other. A document is one record; the windows of a common passage are spread
    by their hashes, and minima over them are combined before they are shuffled. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # a version tells rows apart that share an id but not a text, and so not the places of their windows
    source = id_and_text(docs, id_column, text_column).withColumn("version", F.xxhash64("text"))
    packed = source.mapInArrow(_packed, "doc_id long, packed binary, version long")
    spans = repeated_spans(source, packed, window, kmer)
    gathered = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, kept binary"
    types = schema_of(spark, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpack.decompress(text).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["first"]] += 1
                    gone[min(len(words), s["first"] + s["count"] + window - 1)] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                left = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                rows.append((doc_id, len(words), len(words) - len(left), b" ".join(left)))
                if len(rows) == 512:
                    yield as_batch(rows, types)
                    rows = []
            if rows:
                yield as_batch(rows, types)

    return packed.join(gathered, ["doc_id", "version"], "left").select("doc_id", "packed", "spans").mapInArrow(run, out)


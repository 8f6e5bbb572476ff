"""Near duplicates by SimHash fingerprints that are compared in bit planes, and by shingle sets that such bits propose.

Fingerprints that differ in few bits agree on some block of bits. Rows that agree on a block meet in one group; there bit j
of 64 fingerprints stands in one word, so one operation works on 64 distances. Distances are counted by carry-save
adders, and a word is abandoned once all its distances exceed the radius.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import as_batch, bounded_batches, id_and_text, map_rows, schema_of, written
from rulemill.llm.components import connected_components

HASH_SEED = 42
_LANES = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

#: Rows of one block that are compared in one task; a larger block is cut into chunks, and every two chunks meet.
CHUNK = 8192
#: Rows of whole blocks that are packed into planes at once.
PACK = 1 << 17


def fingerprint(words: list[bytes], shingle: int, lanes: int = 1) -> list[int]:
    """`lanes` words of 64 bits; a bit is set if it is set in over half of the shingle hashes. Without words all bits are zero.

    The hash of lane 0 is XXH64 with seed 42; those of further lanes are mixed from it.
    """
    return majority(_hashes(words, shingle), lanes) if words else [0] * lanes


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], np.uint64)


def majority(first: np.ndarray, lanes: int) -> list[int]:
    """`lanes` words of the bits that are set in over half of the hashes, which are those of lane 0."""
    n = len(first)
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, n, 255):  # a byte holds 255 counts
        part = np.broadcast_to(first[at : at + 255], (lanes, len(first[at : at + 255]))).copy()
        if lanes > 1:
            other = part[1:] + _LANES[1:lanes, None]
            other = (other ^ (other >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            other = (other ^ (other >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            part[1:] = other ^ (other >> np.uint64(31))
        for bit in range(8):
            sums = ((part >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(1, dtype=np.uint64)
            counts[:, bit::8] += sums.view(np.uint8).reshape(lanes, 8)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, version, n_shingles, f0, f1, ...) for every row: signed 64-bit lanes over the shingles of the text's words, A-Z in lower case.

    A NULL text has no words and no shingle. `version` is a hash of the text, which tells rows with the same id apart.
    """

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, version in texts:
            words = (text or b"").lower().split()
            count = max(1, len(words) - shingle + 1) if words else 0
            yield (doc_id, version, count, *(x - (1 << 64) if x >> 63 else x for x in fingerprint(words, shingle, lanes)))

    source = id_and_text(docs, id_column, text_column).withColumn("version", F.xxhash64("text"))
    return map_rows(source, rows, ", ".join(["doc_id long", "version long", "n_shingles int", *(f"f{i} long" for i in range(lanes))]))


def pigeonhole(radius: int, spare: int = 1) -> list[list[int]]:
    """Bit positions of 64-bit keys such that two fingerprints within the radius agree on at least one key.

    The bits are cut into radius + 1 + spare blocks; at most `radius` of them differ, so some spare + 1 blocks agree.
    """
    blocks = np.array_split(np.arange(64), radius + 1 + spare)
    return [np.concatenate(c).tolist() for c in combinations(blocks, spare + 1)]


def random_keys(lanes: int, bits: int, count: int, seed: int = 2) -> list[list[int]]:
    """Keys of randomly chosen bits, for radii too large for a pigeonhole."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(64 * lanes, bits, replace=False).tolist()) for _ in range(count)]


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(values: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows in the same block that differ in at most `radius` bits.

    values: (rows, lanes) unsigned; ends: for each row where its block ends. Rows of a block are neighbours.
    """
    n, lanes = values.shape
    width = -(-n // 64)
    planes = np.zeros((64 * lanes, width), np.uint64)
    for j in range(64 * lanes):
        bits = ((values[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.uint8)
        planes[j] = np.frombuffer(np.packbits(np.pad(bits, (0, 64 * width - n)), bitorder="little").tobytes(), "<u8")
    here = np.arange(n)
    first, stop = (here + 1) // 64, -(-ends // 64)
    spans = np.maximum(0, stop - first)
    spans[here + 1 >= ends] = 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = np.cumsum(spans)
    step, all_ones = 1 << 20, np.uint64(0xFFFFFFFFFFFFFFFF)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + step, "right")))
        row = np.repeat(here[a:b], spans[a:b])
        if len(row):
            word = first[row] + np.arange(len(row)) - (done[row] - spans[row] - (done[a - 1] if a else 0))
            # lanes outside (row, end of block) count as exceeded from the start
            low, high = np.clip(row + 1 - 64 * word, 0, 64), np.clip(ends[row] - 64 * word, 0, 64)
            ones = lambda k: np.where(k >= 64, all_ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
            over = ~(ones(high) & ~ones(low))
            for i, j in _count(planes, values, row, word, over, radius):
                found.append((i, j))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _count(planes, values, row, word, over, radius):
    digits = max(3, int(radius + 1).bit_length())
    # counters start so high that the first distance beyond the radius carries out of the last digit
    preset = (1 << digits) - 1 - radius
    zero, all_ones = np.zeros(len(row), np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(len(row), all_ones if preset >> d & 1 else 0, np.uint64) for d in range(digits)]
    for at in range(0, len(planes), 7):
        differ = [planes[j, word] ^ (np.uint64(0) - ((values[row, j // 64] >> np.uint64(j % 64)) & np.uint64(1))) for j in range(at, min(at + 7, len(planes)))]
        differ += [zero[: len(row)]] * (7 - len(differ))
        s1, c1 = _full_add(*differ[:3])
        s2, c2 = _full_add(*differ[3:6])
        s, c3 = _full_add(s1, s2, differ[6])
        twos, fours = _full_add(c1, c2, c3)
        carry = zero[: len(row)]
        for d in range(digits):
            counter[d], carry = _full_add(counter[d], (s, twos, fours)[d] if d < 3 else zero[: len(row)], carry)
        over = over | carry
        alive = over != all_ones
        if not alive.all():
            row, word, over, counter = row[alive], word[alive], over[alive], [c[alive] for c in counter]
        if not len(row):
            return
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, lane = np.nonzero(near)
    yield row[which], word[which] * 64 + lane


def within_radius(radius: int) -> Callable[[DataFrame], DataFrame]:
    """Links of 64-bit fingerprints that differ in at most `radius` bits; none is missed."""
    return lambda nodes: links(nodes, 1, radius, pigeonhole(radius))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked to, over any number of links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def links(prints: DataFrame, lanes: int, radius: int, keys: Sequence[Sequence[int]], chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (node, f0, ...) -> edges (a, b) between nodes, enough to connect all that agree on a key and are within the radius.

    Each group of rows yields the links of a spanning forest, not all its pairs. A block with more than `chunk` rows is cut
    by a hash into chunks of which every two meet in a task of their own: no pair is lost, and no task holds the block.
    """
    names = [f"f{i}" for i in range(lanes)]

    def key_of(bits: Sequence[int], number: int):
        masks = [sum(1 << (b % 64) for b in bits if b // 64 == lane) for lane in range(lanes)]
        parts = [F.col(names[i]).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for i, m in enumerate(masks) if m]
        return F.xxhash64(F.lit(number), *parts)

    keyed = prints.select("node", *names, F.explode(F.array(*[key_of(k, i) for i, k in enumerate(keys)])).alias("key"))
    return _compared(keyed, lanes, radius, chunk, _forest)


def _forest(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The links of a spanning forest of the pairs."""
    root = _roots(len(table), i, j)
    tied = np.flatnonzero(root != np.arange(len(table)))
    return np.stack([table[root[tied], 0], table[tied, 0]], 1)


def _compared(keyed: DataFrame, lanes: int, radius: int, chunk: int, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], pack: int = PACK) -> DataFrame:
    """Rows (node, f0, ..., more longs, key) -> what `pick` makes of the pairs (i, j) of rows with equal keys and within the radius."""
    large = keyed.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > chunk)
    large = written(large.select("key", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks")), "simhash-large")
    types = schema_of(keyed.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _whole_blocks(batches, pack):
            table, i, j = _near(table, lanes, radius)
            if len(i):
                yield from _as_pairs(pick(table, i, j), types)

    return _dealt(keyed, large).mapInArrow(run, "a long, b long")


def _dealt(keyed: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (node, ..., key) sorted by block (key, low, high). Those of the keys in `large` (key, chunks) are dealt into chunks by a hash; every two chunks are a block."""
    names = [c for c in keyed.columns if c != "key"]
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("chunks")).cast("int")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1), lambda c: F.struct(F.least(c, F.coalesce(own, F.lit(0))).alias("low"), F.greatest(c, F.coalesce(own, F.lit(0))).alias("high"))))
    if large.isEmpty():
        dealt = keyed.select(*names, "key", F.lit(0).alias("low"), F.lit(0).alias("high"))
    else:
        dealt = keyed.join(large, "key", "left").withColumn("meet", other).select(*names, "key", "meet.low", "meet.high")
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _whole_blocks(batches: Iterator[pa.RecordBatch], pack: int, most_values: int = 1 << 22) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Batches of sorted rows of longs, the last three of which name a block -> tables of whole blocks, of more than `pack` rows where there are as many.

    A first column of lists is apart from the table, one array for each row; `most_values` of them close a table too.
    """
    held, lists, rows, values = [], [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = batch.columns
        if pa.types.is_list(columns[0].type):
            bounds, flat = columns[0].offsets.to_numpy(), columns[0].values.to_numpy()
            lists += [flat[a:b].copy() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            values, columns = values + int(bounds[-1] - bounds[0]), columns[1:]
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1))
        rows += batch.num_rows
        if rows > pack or values > most_values:
            table = np.concatenate(held)
            # the last block may go on in the next batch
            last = np.flatnonzero((table[:, -3:] != table[-1, -3:]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield table[:cut], lists[:cut]
            held, lists, rows = [table[cut:]], lists[cut:], len(table) - cut
            values = sum(map(len, lists))
    if rows:
        yield np.concatenate(held), lists


def _near(table: np.ndarray, lanes: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that are not alone in their block, and their pairs (i, j) of one block within the radius."""
    sizes = _block_sizes(table)
    table, sizes = table[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    if not len(sizes):
        return table, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return table, *within(np.ascontiguousarray(table[:, 1 : 1 + lanes]).view(np.uint64), np.repeat(np.cumsum(sizes), sizes), radius)


def _block_sizes(table: np.ndarray) -> np.ndarray:
    change = np.flatnonzero((table[1:, -3:] != table[:-1, -3:]).any(1)) + 1
    return np.diff(np.concatenate(([0], change, [len(table)])))


def _as_pairs(pairs: np.ndarray, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(pairs, axis=0)
    for at in range(0, len(pairs), 1 << 16):
        yield as_batch(list(map(tuple, pairs[at : at + (1 << 16)].tolist())), types)


def group(prints: DataFrame, lanes: int, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fingerprint rows -> the same rows with `root`, which names their component, and `component_id`, the smallest doc_id in it.

    Rows with equal fingerprints are one node; `link` gives the edges between nodes. NULL ids never
    name a component unless it has no other. Repeated rows are in one node too. With an empty table nothing is linked.
    """
    names = [f"f{i}" for i in range(lanes)]
    prints = written(prints, "simhash-prints")
    node = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    nodes = prints.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", node)
    nodes = written(nodes, "simhash-nodes")
    roots = connected_components(link(nodes.select("node", *names)))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(nodes.join(smallest, "root").select(*names, "root", "component_id"), "simhash-named")
    return prints.join(named, names)


#: Lanes of the coarse and of the full fingerprint of near duplicates.
COARSE, FULL = 2, 16


def differing_share(similarity: float) -> float:
    """The share of bits that differ, on average, for two sets of shingles of equal size with a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float, lanes: int, deviations: float) -> int:
    """The mean number of differing bits at this similarity and some standard deviations more."""
    share, bits = differing_share(similarity), 64 * lanes
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def near_duplicate_keys(bits: int = 13, count: int = 48) -> list[list[int]]:
    """Keys of the coarse bits: a pair whose bits differ with probability 0.15 (a similarity of 0.8) agrees on one of them with
    probability 0.98. A corpus of very many texts wants more bits, for smaller blocks, and more keys."""
    return random_keys(COARSE, bits, count)


#: MinHash keys of large sets: two sets with a similarity of 0.8 share none of the 24 with probability 0.59 ** 24, below 1e-5.
BANDS, PER_BAND = 24, 4
#: Distinct shingles from which a set is large; a small one has exact keys.
LARGE = 80
#: Differing bits beyond which small sets, whose bits vary more, are not compared: 0.2 of 1,024 and seven standard deviations.
SMALL_RADIUS = 300
_MINIMA = np.random.default_rng(11).integers(0, 1 << 63, BANDS * PER_BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles of the words, A-Z in lower case, in their order as numbers."""
    words = (text or b"").lower().split()
    return np.unique(_hashes(words, shingle)) if words else np.zeros(0, np.uint64)


def set_keys(hashes: np.ndarray, similarity: float) -> list[int]:
    """Keys, of which similar sets share one: the smallest hashes of a small set, of which sets that overlap enough share one for
    certain, and MinHash bands of a large one. Sizes between the two have both."""
    n, keys = len(hashes), []
    if n < LARGE / similarity:
        keys += hashes[: n - math.ceil(similarity * n - 1e-9) + 1].tolist()
    if n >= LARGE:
        least = np.full(len(_MINIMA), ~np.uint64(0))
        for at in range(0, n, 4096):
            np.minimum(least, (hashes[at : at + 4096] * _MINIMA[:, None]).min(1), out=least)
        keys += [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(least.reshape(BANDS, PER_BAND))]
    return keys


def set_prints(docs: DataFrame, shingle: int, similarity: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, version, node, n_shingles, f0, ..., f15, keys) for every row, all over its distinct shingles; `node` names the set."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, version in texts:
            hashes = shingle_set(text, shingle)
            bits = majority(hashes, FULL) if len(hashes) else [0] * FULL
            node = xxhash.xxh64_intdigest(hashes.tobytes(), HASH_SEED)
            yield (doc_id, version, signed(node), len(hashes), *map(signed, bits), [signed(k) for k in set_keys(hashes, similarity)])

    source = id_and_text(docs, id_column, text_column).withColumn("version", F.xxhash64("text"))
    lanes = (f"f{i} long" for i in range(FULL))
    return map_rows(source, rows, ", ".join(["doc_id long", "version long", "node long", "n_shingles long", *lanes, "keys array<long>"]), 1024)


def _candidates(table: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows (node, f0, ..., f15, n_shingles, ...) that may be similar by their sizes and bits."""
    size, radius = table[:, 1 + FULL], radius_for(similarity, FULL, 6)
    fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
    i, j = i[fits], j[fits]
    bits = np.ascontiguousarray(table[:, 1 : 1 + FULL]).view(np.uint64)
    distance = sum(np.bitwise_count(bits[i, k] ^ bits[j, k]).astype(np.int64) for k in range(FULL))
    near = (distance <= radius) | (np.minimum(size[i], size[j]) < LARGE)
    return i[near], j[near]


def _similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of sets, a spanning forest of those with the Jaccard similarity or more. Pairs that are tied already are not looked at."""
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    here, root, found = np.zeros(len(distinct), bool), np.arange(len(sets)), []
    edges = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)]))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        one = int(i[a])
        others = j[a:b][root[j[a:b]] != root[one]]
        if not len(others):
            continue
        own = ids[starts[one] : starts[one] + sizes[one]]
        here[own] = True
        step = max(1, (1 << 20) // int(sizes[others].max()))
        for at in range(0, len(others), step):
            some = others[at : at + step]
            n = sizes[some]
            ends = np.cumsum(n)
            common = np.add.reduceat(here[ids[np.arange(ends[-1]) + np.repeat(starts[some] - (ends - n), n)]], ends - n, dtype=np.int64)
            for other in some[common / (sizes[one] + n - common) >= similarity].tolist():
                if root[other] != root[one]:
                    root[root == root[other]] = root[one]
                    found.append((one, other))
        here[own] = False
    tied = np.array(found, np.int64).reshape(-1, 2)
    return tied[:, 0], tied[:, 1]


#: Rows and distinct shingles of a chunk of a group whose sets are compared; a task holds two chunks.
SET_ROWS, SET_SHINGLES = 1024, 1 << 21


def similar_links(nodes: DataFrame, sets: DataFrame, similarity: float, rows: int = SET_ROWS, shingles: int = SET_SHINGLES) -> DataFrame:
    """Rows (node, f0, ..., f15, n_shingles, key) and their sets (node, hashes) -> links (a, b) that connect all pairs of a key with the Jaccard similarity or more.

    Every set is sent to the tasks where it is compared, once for each chunk of its group, not once for each pair.
    """
    lanes = [f"f{i}" for i in range(FULL)]
    per_key = nodes.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n_shingles") / shingles)).cast("int").alias("chunks"))
    large = written(per_key.filter("chunks > 1"), "simhash-large")
    types = schema_of(nodes.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, held in _whole_blocks(batches, 1 << 12, 2 * shingles):
            alone = np.repeat(sizes := _block_sizes(table), sizes) == 1
            held = [held[k] for k in np.flatnonzero(~alone).tolist()]
            table, i, j = _near(table, FULL, SMALL_RADIUS)
            i, j = _candidates(table, i, j, similarity)
            if len(i):
                i, j = _similar(held, i, j, similarity)
                yield from _as_pairs(np.stack([table[i, 0], table[j, 0]], 1), types)

    keyed = nodes.select("node", *lanes, "n_shingles", "key").join(sets, "node").select("hashes", "node", *lanes, "n_shingles", "key")
    return _dealt(keyed, large).mapInArrow(run, "a long, b long")


def similar_roots(prints: DataFrame, docs: DataFrame, shingle: int, similarity: float, text_column: str = "text") -> DataFrame | None:
    """Rows of `set_prints` -> (node, root) of the nodes that are tied by pairs of the similarity or more; None if there are none.

    Bits and keys only propose pairs, and of them a spanning forest; distinct shingles decide on all pairs in each of its trees.
    """
    lanes = [f"f{i}" for i in range(FULL)]
    nodes = written(prints.filter("n_shingles > 0").dropDuplicates(["node"]), "simhash-nodes")
    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key")
    keyed = written(keyed.join(shared, "key", "left_semi"), "simhash-keys")
    rows = keyed.join(nodes, "node").select("node", *lanes, "n_shingles", "key")
    proposed = _compared(rows, FULL, SMALL_RADIUS, 1024, lambda table, i, j: _forest(table, *_candidates(table, i, j, similarity)), 1 << 14)
    trees = connected_components(proposed)
    partners = written(nodes.join(trees, "node").select("node", *lanes, "n_shingles", "version", F.col("root").alias("key")), "simhash-partners")
    if partners.isEmpty():
        return None
    sets = written(_sets(docs, partners, shingle, text_column), "simhash-sets")
    links = written(similar_links(partners, sets, similarity), "simhash-links")
    return None if links.isEmpty() else connected_components(links)


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, text_column: str) -> DataFrame:
    """(node, hashes) of the nodes, from one text of each."""

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        for node, text in texts:
            yield node, shingle_set(text, shingle).view(np.int64).tolist()

    bounded_batches(docs.sparkSession)
    texts = docs.select(column(text_column).cast("string").cast("binary").alias("text")).withColumn("version", F.xxhash64("text"))
    texts = _likely(texts, nodes.select("version"), "version").dropDuplicates(["version"])
    return map_rows(texts.join(nodes.select("node", "version"), "version").select("node", "text"), rows, "node long, hashes array<long>", 256)


#: Bits for each hash that `_likely` looks for, and words of 64 bits at most: more hashes let more other rows through.
BITS_EACH, MOST_WORDS = 16, 1 << 18


def _likely(df: DataFrame, wanted: DataFrame, name: str, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows whose hash `name` is in `wanted`, and few others: one bit for each hash is sent to all tasks, so that rows
    which a join would drop are not shuffled for it, however large the two tables are."""
    words = min(most_words, max(1, BITS_EACH * wanted.count() // 64))
    word, bit = F.pmod(name, F.lit(words)).alias("__word"), F.shiftrightunsigned(name, 58).cast("int")
    bits = wanted.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, 58) as int))")).alias("__bits"))
    return df.withColumn("__word", word).join(F.broadcast(bits), "__word").where(F.getbit("__bits", bit) == 1).select(*df.columns)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one in each group of near duplicates is left: the one with the smallest id.

    Similar are texts whose distinct `shingle`-word shingles have a Jaccard similarity of `similarity` or more; a group is what
    such pairs connect. Sets below LARGE shingles share a key for certain, larger ones a MinHash key
    very likely; pairs beyond a wide bit radius are not compared. Of rows that share id
    and text one is left; rows without words are one group; a NULL id counts as larger than all others.
    """
    prints = written(set_prints(docs, shingle, similarity, id_column, text_column), "simhash-prints")
    roots = similar_roots(prints, docs, shingle, similarity, text_column)
    grouped = prints.select("doc_id", "version", "node")
    grouped = grouped.withColumn("root", F.col("node")) if roots is None else grouped.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("first"))
    null_id = F.lit(-(1 << 63)).cast("long")
    kept = written(first.select(F.coalesce("first.doc_id", null_id).alias("__id"), F.col("first.version").alias("__version")), "simhash-kept")
    rows = docs.select("*", F.coalesce(column(id_column).cast("long"), null_id).alias("__id"), F.xxhash64(column(text_column).cast("string").cast("binary")).alias("__version"))
    # copies of one row are combined before they are shuffled; the join then uses the same partitions
    return rows.dropDuplicates(["__id", "__version"]).join(kept, ["__id", "__version"], "left_semi").select(*map(column, docs.columns))

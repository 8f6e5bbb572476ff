"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A trigram binds the vectors of its letters, rotated by their place; a document
bundles its trigrams, a language bundles its documents, and a document gets the language with the largest cosine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import bounded_batches, map_rows

DIMENSIONS = 1024
SEED = 5
#: Characters that are profiled at once, and trigram vectors that a worker keeps.
SEGMENT, KEPT_VECTORS = 1 << 20, 12_000
#: Document vectors are bundled as integers of this scale, so that the order of adding does not matter.
SCALE = 1 << 20
UNDETERMINED = "und"

_BLANK = 32


class Profiler:
    """Text -> bundled trigram vector."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        #: Distinct trigrams of the text that was profiled last, counted segment by segment.
        self.kinds = 0
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.vectors = np.empty((KEPT_VECTORS, self.dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 50_000:
                self.letters = {}
            self.letters[point] = np.random.default_rng((self.seed, point)).choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.letters[point]

    def bind(self, code: int) -> np.ndarray:
        first, second, third = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(first), 2) * np.roll(self.letter(second), 1) * self.letter(third)

    def rows(self, codes: list[int]) -> list[int]:
        fresh = [c for c in codes if c not in self.place]
        if len(self.place) + len(fresh) > KEPT_VECTORS:
            self.forget()
            fresh = codes
        for c in fresh:
            self.vectors[len(self.place)] = self.bind(c)
            self.place[c] = len(self.place)
        return [self.place[c] for c in codes]

    def profile(self, text: str) -> np.ndarray | None:
        """None if the text has no letter. Other characters separate words; trigrams lie within a word and its two edges."""
        self.kinds = 0
        total, found, tail = np.zeros(self.dimensions, np.float32), False, np.full(1, _BLANK, np.int64)
        for at in range(0, len(text), SEGMENT):
            points = np.frombuffer(text[at : at + SEGMENT].lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
            points[~self.is_letter[points]] = _BLANK
            points = np.concatenate((tail, points, np.full(int(at + SEGMENT >= len(text)), _BLANK)))
            blank = points == _BLANK
            found = found or not blank.all()
            points = np.delete(points, np.flatnonzero(blank[1:] & blank[:-1]) + 1)
            tail = points[-2:].copy()
            if len(points) > 2:
                codes = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[points[1:-1] != _BLANK]
                kinds, counts = np.unique(codes, return_counts=True)
                self.kinds += len(kinds)
                for k in range(0, len(kinds), KEPT_VECTORS // 2):
                    part = slice(k, k + KEPT_VECTORS // 2)
                    total += counts[part].astype(np.float32) @ self.vectors[self.rows(kinds[part].tolist())]
        return total if found else None


_PROFILERS: dict[tuple, Profiler] = {}


def profiler(dimensions: int, seed: int) -> Profiler:
    if (dimensions, seed) not in _PROFILERS:
        _PROFILERS[dimensions, seed] = Profiler(dimensions, seed)
    return _PROFILERS[dimensions, seed]


def _unit(vector: np.ndarray) -> np.ndarray:
    return vector / max(float(np.linalg.norm(vector)), 1e-9)


def _text(text_column: str) -> Column:
    return column(text_column).cast("string").alias("text")


def learn(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """language -> prototype of length one, from all rows with a language and a letter.

    Each task bundles its documents per language; only the sums, one vector per language, reach the driver. With no such row
    nothing is learned.
    """

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        profiles, sums = profiler(dimensions, seed), {}
        for lang, text in texts:
            vector = profiles.profile(text or "")
            if vector is not None:
                sums.setdefault(lang, np.zeros(dimensions, np.int64))
                sums[lang] += np.rint(_unit(vector) * SCALE).astype(np.int64)
        for lang, vector in sums.items():
            yield lang, vector.tolist()

    labelled = docs.select(column(lang_column).cast("string").alias("lang"), _text(text_column)).filter("lang IS NOT NULL")
    sums = map_rows(labelled, rows, "lang string, vector array<long>")
    bundled = sums.select("lang", F.posexplode("vector").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v"))
    vectors = bundled.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("v"))
    return {r["lang"]: _unit(np.array(r["v"], np.float64)).astype(np.float32) for r in sorted(vectors.collect(), key=lambda r: r["lang"])}


def identify(
    docs: DataFrame, model: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (),
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) for every row: the learned language with the largest cosine, and that cosine (0 if negative).

    `und` with score 0 where the text is NULL or has no letter, or nothing was learned. Ties go to the language that sorts first.
    Only the text is looked at; `keep` names columns to carry along.
    """
    names = sorted(model)
    prototypes = np.stack([model[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        profiles = profiler(dimensions, seed)
        for text, *kept in texts:
            vector = profiles.profile(text or "") if names else None
            if vector is None:
                yield (*kept, UNDETERMINED, 0.0)
            else:
                cosines = prototypes @ _unit(vector)
                best = int(np.argmax(cosines))
                yield (*kept, names[best], min(1.0, max(0.0, float(cosines[best]))))

    kept = docs.select(_text(text_column), column(id_column).alias("doc_id"), *map(column, keep))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return map_rows(kept, rows, f"{types}, lang_pred string, score double")


#: language -> size of the text (binary digits of its distinct trigrams) -> least cosine and least margin to the runner-up.
Bounds = dict[str, dict[int, tuple[float, float]]]


def _best(prototypes: np.ndarray, vector: np.ndarray) -> tuple[int, float, float]:
    """The best language, its cosine, and its margin to the runner-up (1 without one)."""
    cosines = prototypes @ _unit(vector)
    best = int(np.argmax(cosines))
    return best, float(cosines[best]), float(cosines[best] - np.delete(cosines, best).max()) if len(cosines) > 1 else 1.0


def bounds(
    docs: DataFrame, model: dict[str, np.ndarray], quantile: float = 0.01, share: float = 0.5, lang_column: str = "lang", text_column: str = "text",
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> Bounds:
    """What a text of a language has at least: a share of the low quantile of the cosines, and of the margins, of all labelled rows
    that are found to be in their language, for texts of about the same number of distinct trigrams.

    Tasks count cosines and margins in steps of 1/256; only these counts reach the driver.
    """
    names = sorted(model)
    prototypes = np.stack([model[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        profiles, counts = profiler(dimensions, seed), Counter()
        for lang, text in texts:
            vector = profiles.profile(text or "") if names else None
            if vector is not None:
                best, cosine, margin = _best(prototypes, vector)
                if names[best] == lang:
                    size = profiles.kinds.bit_length()
                    counts.update([(lang, size, 0, int(256 * max(0.0, cosine))), (lang, size, 1, int(256 * margin))])
        for key, n in counts.items():
            yield (*key, n)

    labelled = docs.select(column(lang_column).cast("string").alias("lang"), _text(text_column)).filter("lang IS NOT NULL")
    counted = map_rows(labelled, rows, "lang string, size int, kind int, step int, n long").groupBy("lang", "size", "kind", "step").agg(F.sum("n").alias("n"))
    steps: dict[tuple, list] = {}
    for r in counted.collect():
        steps.setdefault((r["lang"], r["size"], r["kind"]), []).append((r["step"], r["n"]))

    def low(found: list[tuple[int, int]]) -> float:
        found = sorted(found)
        at = np.searchsorted(np.cumsum([n for _, n in found]), quantile * sum(n for _, n in found), "right")
        return share * found[int(at)][0] / 256

    out: Bounds = {}
    for lang, size, _ in steps:
        out.setdefault(lang, {})[size] = (low(steps[lang, size, 0]), low(steps[lang, size, 1]))
    return out


def _bound(of_language: dict[int, tuple[float, float]], size: int) -> tuple[float, float]:
    """The bounds for the size; for one that was not met those of the next smaller texts, or else of the smallest."""
    return of_language[max((s for s in of_language if s <= size), default=min(of_language))] if of_language else (0.0, 0.0)


def recognised(docs: DataFrame, model: dict[str, np.ndarray], accepted: tuple[str, ...] | None = None, least: float | Bounds = 0.0, text_column: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The rows, with all their columns, whose text is found to be in an accepted language (all learned ones by default).

    Rejected are texts that are NULL or have no letter, other languages, and cosines below `least`, or cosines and margins below
    the `bounds` of the language. One narrow pass.
    """
    names = sorted(model)
    wanted = [accepted is None or n in accepted for n in names]
    prototypes = np.stack([model[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def fits(profiles: Profiler, text: str | None) -> bool:
        vector = profiles.profile(text or "") if names else None
        if vector is None:
            return False
        best, cosine, margin = _best(prototypes, vector)
        if isinstance(least, dict):
            low, apart = _bound(least.get(names[best], {}), profiles.kinds.bit_length())
            return wanted[best] and cosine >= low and margin >= apart
        return wanted[best] and max(0.0, cosine) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = profiler(dimensions, seed)
        for batch in batches:
            yield batch.filter(pa.array([fits(profiles, t) for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

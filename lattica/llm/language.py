"""Operator 10, language ID: hyperdimensional profiles of letter trigrams.

Each letter has a random vector of +1 and -1, drawn from a seeded hash of its
code point. A trigram's vector binds its letters' vectors, the first rotated
twice and the second once, by element-wise product. A document's vector bundles
its trigrams' vectors by addition; a language's prototype bundles its training
documents. The language whose prototype has the largest cosine with the
document is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.tokens import by_bytes
from lattica.session import table

#: Of the vectors; their seed.
DIMENSIONS, SEED = 1024, 20_260
#: Trigram vectors that one worker keeps before it starts anew.
MEMO_TRIGRAMS = 40_000
#: Bytes of text that are turned into counts at once.
BATCH_BYTES = 512 << 10
#: Code points of a text that are counted at once, trigrams that are bound at once, and cells of a table of counts.
PIECE_CHARS, BOUND_TRIGRAMS, COUNT_CELLS = 1 << 20, 8_192, 1 << 24
#: Languages that a profile may hold: bounds what the driver gathers (languages x dimensions).
MAX_LANGUAGES = 1000
UNKNOWN = "und"


def _lower_table() -> np.ndarray:
    """For code points of the basic plane: the lower-case letter, or 0 where there's no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Trigrams:
    """Counts of a text's letter trigrams, and the trigrams' vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.table = _lower_table()
        self.letters: dict[int, np.ndarray] = {}
        self.places: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int8)

    def _letters(self, text: str) -> np.ndarray:
        """The lower-case letter for each code point, 0 for anything else."""
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = self.table[np.minimum(c, 0xFFFF)]
        for k in np.flatnonzero(c > 0xFFFF):
            ch = chr(c[k])
            low[k] = ord(ch.lower()[0]) if ch.isalpha() else 0
        return low.astype(np.uint64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the letters, with one 0 for each run of anything else and at either end; none if there's no letter."""
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        tail = np.zeros(1, np.uint64)  # the last two codes so far
        for at in range(0, len(text), PIECE_CHARS):
            last = at + PIECE_CHARS >= len(text)
            low = np.concatenate([tail, self._letters(text[at : at + PIECE_CHARS]), np.zeros(int(last), np.uint64)])
            keep = np.ones(len(low), bool)
            keep[len(tail) :] = (low[len(tail) :] != 0) | (low[len(tail) - 1 : -1] != 0)
            c = low[keep]
            tail = c[-2:]
            found, times = np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:], return_counts=True)
            if len(keys):
                found, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
                times = np.bincount(place, np.concatenate([n, times])).astype(np.int64)
            keys, n = found, times
        return keys, n

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            rng = np.random.Generator(np.random.PCG64([self.seed, code]))
            self.letters[code] = (rng.integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Places of trigrams in `vectors`; new ones are bound."""
        if len(self.places) + len(keys) > MEMO_TRIGRAMS:
            self.places.clear()
        out = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys.tolist()):
            at = self.places.get(key)
            if at is None:
                at = self.places[key] = len(self.places)
                if at >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                a, b, c = self._letter(key >> 42), self._letter(key >> 21 & 0x1FFFFF), self._letter(key & 0x1FFFFF)
                self.vectors[at] = np.roll(a, 2) * np.roll(b, 1) * c
            out[k] = at
        return out

    def bundles(self, texts: list[str]) -> np.ndarray:
        """The texts' vectors, a row each; zero for texts without letters. Sums are exact."""
        found = [self.counts(t) for t in texts]
        out = np.zeros((len(texts), self.dimensions))
        at = 0
        while at < len(found):  # texts whose table of counts is bounded: one at least
            to, cells = at + 1, len(found[at][0])
            while to < len(found) and (to + 1 - at) * (cells + len(found[to][0])) <= COUNT_CELLS:
                cells += len(found[to][0])
                to += 1
            self._sum(found[at:to], out[at:to])
            at = to
        return out

    def _sum(self, found: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.zeros((len(found), len(keys)), np.float32 if sum(int(n.sum()) for _, n in found) < 1 << 23 else np.float64)
        begin = 0
        for k, (_, n) in enumerate(found):
            counts[k, at[begin : begin + len(n)]] = n
            begin += len(n)
        for k in range(0, len(keys), BOUND_TRIGRAMS):
            places = self.rows(keys[k : k + BOUND_TRIGRAMS])
            out += counts[:, k : k + BOUND_TRIGRAMS] @ self.vectors[places].astype(counts.dtype)


def learn_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A prototype for each lang of docs (text, lang), from all its rows with a text and a lang.

    The sums are integers, so their order is of no matter. What reaches the
    driver is one row of `dimensions` numbers a language, MAX_LANGUAGES at most.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, BATCH_BYTES):
            of: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                sums[lang] = sums.get(lang, 0) + grams.bundles([" ".join(texts)])[0].astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "place": pa.array(range(dimensions), pa.int32()), "value": v})

    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(bundle, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    rows = packed.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array([x["value"] for x in r["v"]], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text); ties go to the lesser lang.

    A null text, one without a letter, and any text where no language was learned
    give `und` and 0. Null ids and repeated rows stay; other columns are left behind.
    """
    return predicted(docs.select("doc_id", "text"), profiles, seed).select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def predicted(docs: DataFrame, profiles: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """The rows of docs with all their columns, and `__lang` and `__score`.

    The score is the cosine, 0 where it's negative. A null text, one without a
    letter, and any text where no language was learned give `und` and 0.
    """
    names = sorted(profiles)
    units = np.array([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-300) for n in names]).T if names else None
    dimensions = len(units) if names else DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams(dimensions, seed)
        for batch in by_bytes(batches, BATCH_BYTES):
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if names:
                vectors = grams.bundles([t or "" for t in batch.column("text").to_pylist()])
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ units / np.maximum(norms, 1e-300)[:, None]
                best = cosines.argmax(axis=1)
                for k in np.flatnonzero(norms):
                    lang[k] = names[best[k]]
                    score[k] = min(1.0, max(0.0, float(cosines[k, best[k]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score)], [*names_in, "__lang", "__score"])

    names_in = docs.columns
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id's text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of docs (doc_id, text, lang) that aren't held out and predicts all of them."""
    return predict(docs, learn_profiles(docs.filter(~held_out())))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

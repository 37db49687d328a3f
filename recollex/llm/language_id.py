"""Language ID with hyperdimensional profiles.

Every letter of Unicode, in lower case, has a random vector of +1 and -1 of its own, drawn by a hash of its code point. A
three-letter gram is bound from its letters' vectors, the first two permuted by two and by one places, so that order
counts. A text's vector is the bundle (sum) of its grams' vectors, a language's prototype the bundle of its texts' unit
vectors less the mean of all languages; a text gets the language whose prototype has the largest cosine. Bundles are sums
of integers, so prototypes don't depend on how Spark splits the work.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm._hashing import mix
from recollex.llm._shared import lean, learned_crc, text_or_empty

DIM, SEED = 256, 20240131
#: Letters are numbered by code point, a to z first; 0 is the gap between words. Vectors of grams of letters with smaller
#: numbers than this (those of ASCII and Latin-1) are kept, 64 MB at most; others are made when met.
NEAR = 64
#: Code points at once in numpy; a longer text is taken alone.
BLOCK = 1 << 19
#: Grams of other letters that are bound at a time.
BOUND = 4096
#: Unit vectors are rounded to integers of this scale before they are summed.
SCALE = 1 << 12


@functools.cache
def letter_numbers() -> tuple[np.ndarray, np.ndarray]:
    """The number of each code point's letter, -1 for what is no letter, and the lower-case code point of each number."""
    points = np.flatnonzero(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    low = np.fromiter((ord(chr(p).lower()[0]) for p in points.tolist()), np.int64, len(points))
    letters, number = np.unique(low, return_inverse=True)
    out = np.full(0x110000, -1, np.int32)
    out[points] = number + 1
    return out, np.concatenate([[0], letters])


def letter_vectors(numbers: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each letter number."""
    words = letter_numbers()[1][numbers].astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(SEED, SEED + DIM // 64, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(words)).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def _bound(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Vectors of grams; a gap after a gap says nothing."""
    out = np.roll(letter_vectors(a), 2, 1) * np.roll(letter_vectors(b), 1, 1) * letter_vectors(c)
    out[(b == 0) & (c == 0)] = 0
    return out


class _Grams:
    """Vectors of grams of near letters, made when first met."""

    def __init__(self):
        self.index = np.full(NEAR**3, -1, np.int32)
        self.rows = np.zeros((1024, DIM), np.int8)
        self.n = 0

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of grams."""
        at = self.index[grams]
        if (at < 0).any():
            new = np.unique(grams[at < 0])
            while self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n : self.n + len(new)] = _bound(new // NEAR**2, new // NEAR % NEAR, new % NEAR)
            self.index[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            at = self.index[grams]
        return at


@functools.cache
def _grams() -> _Grams:
    return _Grams()


def _kept(text: str, letter_before: bool) -> np.ndarray:
    """Letter numbers of a text, a run of other code points as one gap (none at the start, unless a letter came before)."""
    c = letter_numbers()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = c >= 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] |= letter_before
    return np.where(letter, c, 0)[keep]


def _places(c: np.ndarray) -> np.ndarray:
    """The row of each gram of near letters, -1 for others."""
    near = (c[:-2] | c[1:-1] | c[2:]) < NEAR
    if near.all():
        return _grams().places((c[:-2] * NEAR + c[1:-1]) * NEAR + c[2:])
    out = np.full(len(c) - 2, -1, np.int32)
    k = np.flatnonzero(near)
    out[k] = _grams().places((c[k] * NEAR + c[k + 1]) * NEAR + c[k + 2])
    return out


def _bundle(places: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The sum of the vectors of a text's grams, of which places gives the rows and c the letters."""
    far = np.flatnonzero(places < 0)
    n = np.bincount(places[places >= 0] if len(far) else places)
    used = np.flatnonzero(n)
    out = n[used].astype(np.float32) @ _grams().rows[used].astype(np.float32)
    if len(far):
        keys, counts = np.unique((c[far].astype(np.int64) << 42) | (c[far + 1].astype(np.int64) << 21) | c[far + 2], return_counts=True)
        for k in range(0, len(keys), BOUND):
            part = keys[k : k + BOUND]
            out = out + counts[k : k + BOUND].astype(np.float32) @ _bound(part >> 42, part >> 21 & 0x1FFFFF, part & 0x1FFFFF).astype(np.float32)
    return out


_GAP = np.zeros(1, np.int32)


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text, and whether it has a letter. Each text has a gap before and after it."""
    out, letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK):
            size += len(texts[hi]) + 1
            hi += 1
        if size > BLOCK and hi == lo + 1:  # one long text, block by block
            text, tail = texts[lo], _GAP
            for at in range(0, len(text), BLOCK):
                c = np.concatenate([tail, _kept(text[at : at + BLOCK] + " " * (at + BLOCK >= len(text)), bool(tail[-1]))])
                if len(c) >= 3:
                    out[lo] += _bundle(_places(c), c)
                    letters[lo] = True
                tail = c[-2:]
            letters[lo] |= bool(tail.any())
        else:
            joined = "".join(t + " " for t in texts[lo:hi])
            letter = letter_numbers()[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)] >= 0
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            at = np.concatenate([[0], np.cumsum(keep)[ends - 1]])  # kept code points before each text
            c = np.concatenate([_GAP, _kept(joined, False)])
            if len(c) >= 3:
                g = _places(c)  # g[k] covers kept code points k - 1 to k + 1
                for i in np.flatnonzero(np.diff(at)):
                    out[lo + i] = _bundle(g[at[i] : at[i + 1] - 1], c[at[i] : at[i + 1] + 1])
                    letters[lo + i] = True
        lo = hi
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _bundles(batches):
    """Sums of a partition's unit vectors by language."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for lo in range(0, len(langs), 512):
            v, has = text_vectors([x or "" for x in b.column(0).slice(lo, 512).to_pylist()])
            v = np.rint(_unit(v) * SCALE).astype(np.int64)
            part = np.array(langs[lo : lo + 512], object)
            for lang in set(part[has]):
                sums[lang] = sums.get(lang, 0) + v[(part == lang) & has].sum(0)
    for lang, s in sums.items():
        yield pa.record_batch([pa.array([lang]), pa.array([s.tolist()], pa.list_(pa.int64()))], ["lang", "bundle"])


def fit_prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from all rows of docs (text, lang). A task sends one sum per language."""
    rows = docs.where("lang is not null").select(text_or_empty(docs).alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(lean(_bundles), "lang string, bundle array<long>")
    each = rows.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("b"))
    found = sorted((r["lang"], [x["v"] for x in r["b"]]) for r in each.toLocalIterator())
    if not found:
        return [], np.zeros((0, DIM), np.float32)
    p = _unit(np.array([v for _, v in found], float))
    if len(found) > 1:
        p = _unit(p - p.mean(0))
    return [lang for lang, _ in found], p.astype(np.float32)


def _predict(model):
    def run(batches):
        langs, prototypes = model.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                v, has = text_vectors([x or "" for x in part.column(2).to_pylist()])
                pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if langs:
                    cos = _unit(v) @ prototypes.T
                    best = cos.argmax(1)
                    score = np.where(has, np.clip((1 + cos.max(1)) / 2, 0, 1), 0.0)
                    pred = [langs[k] if h else "und" for k, h in zip(best, has, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(pred), pa.array(score.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, from the text alone. lang_pred is `und` and score 0 for
    a text without a letter (or null); of equal cosines the alphabetically first language wins; score is (1 + cosine) /
    2. held_out is a column to carry (false by default). Without a learned language all are `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.lit(False) if held_out is None else held_out
    return docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), text_or_empty(docs).alias("text")).mapInArrow(lean(_predict(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = learned_crc("doc_id", 5) == 0
    return identify_languages(docs, fit_prototypes(docs.where(~held)), held)

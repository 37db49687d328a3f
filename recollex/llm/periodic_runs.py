"""Periodic runs in texts: harmonic grid probing.

A run of period p that is at least 2p words long holds two neighbours jp and (j+1)p of the grid of p, so testing word
equality there, for every p, misses none; all grids of n words have some n ln n points. Points whose neighbourhood
already differs fall at once, and so do those whose prefix hashes prove that too few words agree (a difference of hashes
is proof; agreement proves nothing). The others are extended to both sides by comparing arrays chunk by chunk, and what
lies in a run just found is skipped: the run's own further points, and those of multiples of its period, which would find
it again. So a text of one repeated word costs no more than any other. A document is worked on alone, and Spark deals the
documents; nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm import _hashing as H
from recollex.llm._shared import lean, text_or_empty

#: A run has this many words at least, and two periods.
LEAST = 12
#: Grid points that are probed at once.
POINTS = 1 << 20
#: Words around a probe that are compared before it is extended.
NEAR = 8
#: First and largest chunk of an extension; each is twice the one before.
CHUNK, MOST_CHUNK = 64, 1 << 16
#: Points that are tested by hashes at a time.
BATCH = 1 << 15
#: A document's found points are kept as period * SHIFT + place.
SHIFT = 1 << 32


def _codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _probed(codes: np.ndarray, least: int) -> np.ndarray:
    """period * SHIFT + place of the grid points jp of all periods whose word equals that at (j+1)p and whose
    neighbourhood leaves room for a run, sorted."""
    n, out = len(codes), [np.zeros(0, np.int64)]
    first, last = 1, n // 2
    while first <= last:
        # the periods from first on that have some POINTS points together
        upto = min(last, first + max(0, POINTS * first // n))
        p = np.arange(first, upto + 1)
        points = (n - 1) // p
        period = np.repeat(p, points)
        at = period * (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points))
        same = codes[at] == codes[at + period]
        out.append(_roomy(codes, at[same], period[same], least))
        first = upto + 1
    return np.concatenate(out)


def _roomy(codes: np.ndarray, at: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """Those of the points around which enough words agree with the word one period on: all that a run needs, or NEAR
    to one side at least, beyond which this can't tell."""
    need = np.maximum(least, 2 * period) - period
    agree, sure = np.ones(len(at), np.int64), np.ones(len(at), bool)
    for side in (-1, 1):
        going = np.arange(len(at))
        for k in range(1, NEAR + 1):
            i = at[going] + side * k
            inside = (i >= 0) & (i + period[going] < len(codes))
            going, i = going[inside], i[inside]
            going = going[codes[i] == codes[i + period[going]]]
            agree[going] += 1
        sure[going] = False  # may go on beyond NEAR
    left = ~sure | (agree >= need)
    return period[left] * SHIFT + at[left]


class _Prefixes:
    """Polynomial hashes of all prefixes, modulo 2**64: whatever they tell apart differs."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, self.BASE)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(H.mix(codes.astype(np.uint64) + np.uint64(1)) * self.power[:-1], dtype=np.uint64)])

    def most(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Upper bounds of the numbers of places around `at` whose words equal those one period on."""
        ahead, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in reversed(range(self.n.bit_length())):
            step = 1 << k
            for done, start, fits in ((ahead, at + ahead, at + ahead + period + step <= self.n), (back, at - back - step, at - back >= step)):
                i = start[fits]
                j = i + period[fits]
                done[np.flatnonzero(fits)[(self.sums[i + step] - self.sums[i]) * self.power[j - i] == self.sums[j + step] - self.sums[j]]] += step
        return ahead + back


def _stretch(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """First place and end of the places around `at` whose words equal those one period on."""
    end, size = at + 1, CHUNK
    while end < len(codes) - period:
        stop = min(end + size, len(codes) - period)
        differ = np.flatnonzero(codes[end:stop] != codes[end + period : stop + period])
        if len(differ):
            end += int(differ[0])
            break
        end, size = stop, min(2 * size, MOST_CHUNK)
    start, size = at, CHUNK
    while start > 0:
        stop = max(start - size, 0)
        differ = np.flatnonzero(codes[stop:start] != codes[stop + period : start + period])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, size = stop, min(2 * size, MOST_CHUNK)
    return start, end


def runs_of(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, sorted by start, then period: stretches with smallest period p and at
    least max(least, 2p) words that no neighbour extends."""
    if len(codes) < max(least, 2):
        return np.zeros((0, 3), np.int64)
    keys = _probed(codes, least)
    dead, found = np.zeros(len(keys), bool), set()
    prefixes = _Prefixes(codes) if len(keys) else None
    for first in range(0, len(keys), BATCH):
        points = first + np.flatnonzero(~dead[first : first + BATCH])
        periods, places = keys[points] // SHIFT, keys[points] % SHIFT
        enough = prefixes.most(places, periods) >= np.maximum(least, 2 * periods) - periods
        for i, period, at in zip(points[enough].tolist(), periods[enough].tolist(), places[enough].tolist(), strict=True):
            if dead[i]:
                continue
            start, end = _stretch(codes, at, period)
            dead[i : np.searchsorted(keys, period * SHIFT + end)] = True
            end += period
            if end - start >= max(least, 2 * period) and (start, end, period) not in found:
                found.add((start, end, period))
                # the same stretch as a run of a multiple of the period
                p = np.arange(2 * period, (end - start) // 2 + 1, period)
                for a, b in zip(np.searchsorted(keys, p * SHIFT + start).tolist(), np.searchsorted(keys, p * SHIFT + end - p).tolist(), strict=True):
                    dead[a:b] = True
    rows = np.array(sorted((s, p, e - s) for s, e, p in found), np.int64).reshape(-1, 3)
    return rows[:, [0, 2, 1]]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those that some run holds after its first period don't."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def run(batches):
        for b in batches:
            data, offs = H.text_buffers(b.column(1))
            for lo, hi in H.chunks_of(offs):
                sizes, ends, rows, texts = [], [0], [], []
                for k in range(lo, hi):
                    words = data[offs[k] : offs[k + 1]].tobytes().split()  # of bytes: at \x20 and \x09-\x0D only
                    runs = runs_of(_codes(words), least)
                    sizes.append(len(words))
                    rows.append(runs)
                    ends.append(ends[-1] + len(runs))
                    if len(runs):
                        words = [words[i] for i in np.flatnonzero(_kept(len(words), runs)).tolist()]
                    texts.append(b" ".join(words))
                flat = np.concatenate([np.zeros((0, 3), np.int64), *rows])
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(_RUN))
                yield pa.record_batch(
                    [b.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For every row of docs: doc_id, n_words, runs (structs of start, length, period, by start and period) and
    collapsed, the text whose runs keep their first period only, words joined by one space.

    Words are what \\x20 and \\x09-\\x0D separate, compared unchanged. Null and empty texts have no words, no runs and an
    empty collapsed text; a null doc_id stays null; a text is read whole, however long; repeated rows get equal results;
    other columns are ignored; an empty table gives none. Runs that start together are told apart by their periods.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(lean(_found(least)), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _periodic_copy(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words of a document whose id asks for it, made periodic from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which a tenth of the texts, those whose crc32 of the id is divisible by ten, are periodic
    from a place on; their words are joined by one space. Rows without an id stay as they are."""

    def run(batches):
        for b in batches:
            texts = [t if i is None or t is None or zlib.crc32(str(i).encode()) % 10 else b" ".join(_periodic_copy(t.encode().split(), i)).decode() for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(lean(run), "doc_id long, text string")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # the greatest length; of several the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

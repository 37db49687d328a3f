"""For each word and two days, the least two notes of opposite moods whose first shared word it is, without listing pairs.

A note is posted under each of its words with the words before it: two notes under a word have it as their first shared one
if those are apart. The notes under one word, day and mood are a run in order of id, and of two runs only the first pair
that is apart is wanted. Pairs are tried in that order, more in each round and all runs at once; two runs that still have
none are settled by bits: for a note of one, the notes of the other that hold any of its words. A frequent word's notes
are dealt to blocks of about ROWS, and each two blocks are a group of their own, so a group's memory is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.operators.setjoin import _flat

#: Most notes in a block, postings in a group of rare words, pairs looked at at once, pairs of two runs that are tried one
#: by one, notes in a slice of bits, and bits of a set's mark.
ROWS, GROUP, PAIRS, TRIED, SLICE, BITS = 16_384, 50_000, 1 << 18, 1024, 2048, 512


def first_pairs(notes: DataFrame) -> DataFrame:
    """topic, id_a, id_b, day_a, day_b of notes (id: unique, day, positive, topics: sorted and distinct): for each topic
    and days day_a < day_b the least (id_a, id_b) of notes that differ in `positive` and share no topic before it."""
    each = notes.where("day IS NOT NULL").select("id", F.unix_date("day").alias("day"), "positive", "topics", F.posexplode("topics").alias("at", "topic"))
    each = each.select("id", "day", "positive", "topic", F.slice("topics", 1, F.col("at")).alias("before"))
    total = notes.agg(F.coalesce(F.sum(F.size("topics")), F.lit(0))).head()[0]
    large = each.groupBy("topic").agg(F.count("*").alias("m")).where(F.col("m") > ROWS).select("topic", F.ceil(F.col("m") / ROWS).cast("int").alias("b"))  # a row for ROWS postings
    rows = each.join(F.broadcast(large), "topic", "left").withColumn("b", F.coalesce("b", F.lit(1)))
    mine = F.pmod(F.xxhash64("id"), F.col("b")).cast("int")
    with_ = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda x: F.struct(F.least(x, "h").alias("i"), F.greatest(x, "h").alias("j")))
    rows = rows.withColumn("h", mine).withColumn("x", F.explode(with_))
    group = F.when(F.col("b") > 1, F.xxhash64("topic")).otherwise(F.pmod(F.xxhash64("topic"), F.lit(1 + total // GROUP)))
    second = (F.col("x.i") < F.col("x.j")) & (F.col("h") == F.col("x.j"))
    rows = rows.select(group.alias("g"), "x.i", "x.j", (F.col("b") > 1).alias("many"), "topic", "id", "day", "positive", second.alias("second"), "before")
    # the work is in the pairs, not in the bytes that Spark would join partitions by
    tasks = max(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * GROUP))
    keys = ["g", "i", "j", "many"]
    found = rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_first, "topic string, id_a long, id_b long, a int, b int")
    least = found.groupBy("topic", "a", "b").agg(F.min(F.struct("id_a", "id_b")).alias("x"))
    return least.select("topic", "x.id_a", "x.id_b", F.date_from_unix_date("a").alias("day_a"), F.date_from_unix_date("b").alias("day_b"))


class _Sets:
    """Sets of numbers one after the other, the i-th from offs[i] to offs[i + 1]."""

    def __init__(self, values: np.ndarray, offs: np.ndarray):
        self.values, self.offs = values, offs
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        spot = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)
        self.marks = np.zeros((len(offs) - 1, BITS // 64), np.uint64)
        np.bitwise_or.at(self.marks, (row, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these sets one after the other, and how many each has."""
        size = self.offs[rows + 1] - self.offs[rows]
        return self.values[_flat(self.offs[rows], size)], size

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sets share nothing."""
        out = np.ones(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            maybe = np.flatnonzero((self.marks[x] & self.marks[y]).any(axis=1))
            keys = []
            for z in (x, y):
                values, size = self.of(z[maybe])
                keys.append(np.repeat(maybe << 32, size) | values)
            key = np.sort(np.concatenate(keys))
            out[s + (key[1:][key[1:] == key[:-1]] >> 32)] = False
        return out


def _by_bits(sets: _Sets, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """The first pair (a, b) of sets a0 to a1 and b0 to b1 that share nothing."""
    best = None
    for s in range(b0, b1, SLICE):
        b = np.arange(s, min(s + SLICE, b1))
        values, size = sets.of(b)
        words, code = np.unique(values, return_inverse=True)
        spot = np.repeat(np.arange(len(b)), size)
        held = np.zeros((len(words) + 1, (len(b) + 7) // 8), np.uint8)  # the last row is a word that none holds
        np.bitwise_or.at(held, (code, spot >> 3), (128 >> (spot & 7)).astype(np.uint8))
        step, x = 16, a0
        while x < a1:  # an earlier slice has lesser b, so it wins for the same a
            a = np.arange(x, min(x + step, a1))
            x, step = int(a[-1]) + 1, min(step * 4, 512)
            values, size = sets.of(a)
            at = np.searchsorted(words, values)
            at[np.append(words, -1)[at] != values] = len(words)
            ends = np.cumsum(size)
            at = np.insert(at, ends - size, len(words))
            met = np.unpackbits(np.bitwise_or.reduceat(held[at], ends - size + np.arange(len(a)), axis=0), axis=1, count=len(b))
            free = np.flatnonzero(~met.all(axis=1))
            if len(free):
                best = int(a[free[0]]), int(b[met[free[0]].argmin()])
                a1 = best[0]
                break
    return best


def _firsts(sets: _Sets, a0: np.ndarray, na: np.ndarray, b0: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each two runs (na sets from a0, nb from b0) the first pair of sets that share nothing; -1 if there is none."""
    x, y = np.full(len(a0), -1), np.full(len(a0), -1)
    open_, done, k, all_ = np.arange(len(a0)), 0, 4, na * nb
    while len(open_) and done < TRIED:
        left = []
        for s in range(0, len(open_), max(1, PAIRS // k)):
            t = open_[s : s + max(1, PAIRS // k)]
            n = np.minimum(all_[t] - done, k)
            u, p = np.repeat(t, n), done + _flat(np.zeros(len(t), np.int64), n)
            a, b = a0[u] + p // nb[u], b0[u] + p % nb[u]
            hit = np.flatnonzero(sets.apart(a, b))
            won, first = np.unique(u[hit], return_index=True)
            x[won], y[won] = a[hit[first]], b[hit[first]]
            left.append(t[(x[t] < 0) & (all_[t] > done + k)])
        open_, done, k = np.concatenate(left), done + k, k * 4
    for t in open_:
        found = _by_bits(sets, int(a0[t] + done // nb[t]), int(a0[t] + na[t]), int(b0[t]), int(b0[t] + nb[t]))
        if found:
            x[t], y[t] = found
    return x, y


def _first(rows: pa.Table) -> pa.Table:
    """A group's least pairs: of all its notes, or of those of two blocks with one of each."""
    topics = rows.column("topic").combine_chunks().dictionary_encode()
    w = topics.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many, i, j = (rows.column(c)[0].as_py() for c in ("many", "i", "j"))
    id_, day = (rows.column(c).to_numpy() for c in ("id", "day"))
    positive, second = (rows.column(c).to_numpy().astype(bool) for c in ("positive", "second"))
    order = np.lexsort((id_, second, positive, day, w))
    w, id_, day, positive, second = w[order], id_[order], day[order].astype(np.int64), positive[order], second[order]
    before = rows.column("before").combine_chunks()
    offs = before.offsets.to_numpy().astype(np.int64)
    code = pc.dictionary_encode(before.values).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(offs)[order]
    code, row = code[_flat(offs[:-1][order], size)], np.repeat(np.arange(len(w)), size)
    shared = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)  # a word of one set keeps no sets together
    sets = _Sets(code[shared], np.append(0, np.cumsum(np.bincount(row[shared], minlength=len(w)))))
    new = lambda *cols: np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
    head = new(w, day, positive, second)
    n = np.diff(np.append(head, len(w)))
    last = np.append(new(w[head])[1:], len(head))
    number = np.repeat(last, np.diff(np.append(0, last))) - np.arange(len(head)) - 1  # the later runs of the same word
    ends, s, out = np.cumsum(number), 0, []
    while s < len(head):
        z = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, side="right")))
        a, b = np.repeat(np.arange(s, z), number[s:z]), _flat(np.arange(s, z) + 1, number[s:z])
        s = z
        p, q = head[a], head[b]
        good = (day[p] < day[q]) & (positive[p] != positive[q])
        if many and i != j:
            good &= second[p] != second[q]
        a, b, p, q = a[good], b[good], p[good], q[good]
        x, y = _firsts(sets, p, n[a], q, n[b])
        got = x >= 0
        x, y = x[got], y[got]
        order = np.lexsort((id_[y], id_[x], day[y], day[x], w[x]))  # a word's days meet in two ways, once for each mood
        x, y = x[order], y[order]
        if len(x):
            keep = new(w[x], day[x], day[y])
            out.append((x[keep], y[keep]))
    x, y = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    cols = [topics.dictionary.take(pa.array(w[x])), id_[x], id_[y], day[x].astype(np.int32), day[y].astype(np.int32)]
    return pa.table(cols, names=["topic", "id_a", "id_b", "a", "b"])

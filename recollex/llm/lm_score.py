"""LM scoring with a weighted backoff automaton.

Counts: all words of the training texts, and all runs of two to `levels` neighbouring words that occur LEAST times,
whatever the corpus size. Each kept run is an arc, absolutely discounted and interpolated with the shorter history; each
run that begins longer kept ones is a state, and its failure arc leads to the state without its first word, with the
weight that makes the state's probabilities sum to one. The root's weights are the smoothed words.

A text is read once from left to right. Where failure arcs lead depends on the last words alone, so a batch of texts is
traversed as arrays: a text's score is the sum of the root's weight of each word, the failure weight of each state that
is left, and of each arc that is taken what it adds to failing. So each word and each kept run has one value, and the
model is a table of values that grows with the corpus. The hot part, the HOT_WORDS and HOT_ARCS most frequent ones at
most, is broadcast; the rest lies in a written table, and what texts need of it is looked up there.

Keys travel in blocks: a row holds, for one part of the texts and one bucket of keys, arrays of keys. Buckets are so many
that each has some BUCKET_BYTES of text to count, and a history that is a large share of the corpus has several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm import _hashing as H
from recollex.llm._shared import BROADCAST_ROWS, discard, give_back, lean, learned_crc, small, staged, text_or_empty
from recollex.llm.substring_dedup import MAX_FILTER_BITS, MIN_FILTER_BITS, _in_filter, filter_of

#: Longest n-grams, least count of kept ones, discount, and what is added to a word's count.
LEVELS, LEAST, DISCOUNT, ALPHA = 2, 2, 0.5, 0.1
#: Most words and arcs that are broadcast; the rest are looked up, with the same result.
HOT_WORDS, HOT_ARCS = 500_000, 1_000_000
#: Bits of the Bloom filters for each key, about.
BITS_PER_KEY = 8
#: Bytes of text that a worker counts and scores at once, and that fill a bucket.
PART, SCORED_PART, BUCKET_BYTES = 8 << 20, 2 << 20, 16 << 20
#: Bytes of keys that are looked up at once.
ASKED_BYTES = 8 << 20
#: Texts are scored in so many waves, so that the keys to look up take disk for one of them at a time.
WAVES = 2
#: The end token's hash.
END = np.uint64(0x51ED270B35AE2D1F)


# ---- texts to keys


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a column's texts, each with its end token, and n + 1 offsets."""
    data, offs = H.text_buffers(column)
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, z in H.chunks_of(offs):
        h, w = H.hashed_words(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], True)
        words.append(h)
        counts.append(np.diff(w))
    words, counts = np.concatenate(words), np.concatenate(counts)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(at[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = words
    return out, at


def _parts(batches, column: int, limit: int = PART):
    """Slices of the batches with about limit bytes of text, so that a worker's arrays stay small."""
    for b in batches:
        _, offs = H.text_buffers(b.column(column))
        for a, z in H.chunks_of(offs, limit):
            yield b.slice(a, z - a)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The key of the run that begins with one key's run and ends with the other's."""
    return H.mix(first * np.uint64(0x9E3779B97F4A7C15) ^ H.mix(second ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


class _Table:
    """Sorted keys with a directory of their first bits, for lookups of many keys."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values, self.places = keys[order], [v[order] for v in values], None

    def __getstate__(self):
        return self.keys, self.values, None

    def __setstate__(self, state):
        self.keys, self.values, self.places = state

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bits = max(1, len(self.keys).bit_length() - 1)
        shift = np.uint64(64 - bits)
        if self.places is None:
            firsts = np.arange(1 << bits, dtype=np.uint64) << shift
            self.places = np.append(np.searchsorted(self.keys, firsts), len(self.keys)).astype(np.uint32)
        slot = (keys >> shift).astype(np.int64)
        at, end = self.places[slot].astype(np.int64), self.places[slot + 1].astype(np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            a = at[live]
            hit = self.keys[a] == keys[live]
            out[live[hit]] = a[hit]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class _Filter:
    """A Bloom filter, or none, which everything passes."""

    def __init__(self, keys: DataFrame | None = None, n: int = 0):
        self.bits, self.table = 0, None
        if keys is not None:
            self.bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (max(n, 1) * BITS_PER_KEY - 1).bit_length()))
            self.table = filter_of(keys, self.bits, n)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        return np.ones(len(keys), bool) if self.table is None else _in_filter(keys, self.table, self.bits)


# ---- counts


def _blocks(level: int, buckets: int, total: int, model):
    """Counts of a part's runs of `level` tokens: (bucket, hist, low, n), arrays of the keys of the runs without the last
    and without the first token, and of counts; of single tokens only low. Runs are left out if the runs of level - 1 in
    them don't pass the filter of kept ones. A bucket is a history's, or one of several if that is a large share."""

    def run(batches):
        heavy, kept = model.value if model is not None else (None, None)
        for b in _parts(batches, 0):
            tokens, at = _tokens(b.column(0))
            if level == 1:
                low, n = np.unique(tokens, return_counts=True)
                hist, bucket = low[:0], _bucket(low, buckets)
            else:
                hist, low = _runs(tokens, at, level, kept)
                key = _joined(hist, low)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
                n = np.diff(np.append(first, len(key)))
                key, hist, low = key[first], hist[order[first]], low[order[first]]
                bucket = _bucket(H.mix(hist), buckets)
                share = heavy.find(hist)
                large = np.flatnonzero(share >= 0)
                if len(large):
                    several = (1 + heavy.values[0][share[large]] / max(total, 1) * buckets).astype(np.uint64)
                    bucket[large] = (bucket[large] + (key[large] % several).astype(np.int32)) % buckets
                order = np.argsort(bucket.astype(np.uint64) << np.uint64(40) | hist >> np.uint64(24))  # equal histories side by side shrink
                hist, low, n, bucket = hist[order], low[order], n[order], bucket[order]
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            yield pa.record_batch([pa.array(bucket[edge[:-1]], pa.int32()), *(_cut(x, edge if len(x) else 0 * edge) for x in (hist, low, n.astype(np.uint32)))], ["bucket", "hist", "low", "n"])

    return run


def _cut(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Blocks of values between neighbouring edges as one column: a part has a block for each bucket, so that what a block
    costs grows with parts times buckets."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _runs(tokens: np.ndarray, at: np.ndarray, level: int, kept) -> tuple[np.ndarray, np.ndarray]:
    """hist and low of the runs of `level` tokens within a text whose runs of level - 1 pass the filter of kept ones."""
    going = np.ones(len(tokens), bool)
    going[at[1:] - 1] = False  # an end token begins no run
    key, ok = tokens, going[:-1]  # ok: where runs of one more token begin
    for size in range(2, level):
        key = _joined(key[:-1], key[1:])
        good = ok & kept.passes(key) if size == level - 1 else ok
        ok = good[:-1] & good[1:]
    where = np.flatnonzero(ok)
    return key[where], key[where + 1]


def _whole(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def _merged(level: int, shorter):
    """A bucket's counts: (k, hist, low, c) of those that occur LEAST times, with pl, the probability of low, where it is
    among the frequent ones; all of single tokens."""

    def run(table: pa.Table) -> pa.Table:
        low, n = _whole(table.column("low")), _whole(table.column("n"), np.uint32).astype(np.int64)
        hist = _whole(table.column("hist")) if level > 1 else low
        key = _joined(hist, low) if level > 1 else low
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[order], first) if len(key) else n
        keep = n >= (LEAST if level > 1 else 1)
        at = order[first[keep]]
        key, hist, low = key[first[keep]], hist[at], low[at]
        found = shorter.value.find(low) if shorter is not None else np.full(len(low), -1)
        p = pa.nulls(len(low), pa.float64()) if shorter is None else pa.array(shorter.value.values[0][found] if len(shorter.value.keys) else np.zeros(len(low)), mask=found < 0)
        give_back()
        return pa.table([*(pa.array(x.view(np.int64)) for x in (key, hist, low)), pa.array(n[keep]), p], names=["k", "hist", "low", "c", "pl"])

    return run


def _table(rows: DataFrame, value: str) -> _Table:
    found = rows.select("k", value).toArrow()
    return _Table(found.column("k").to_numpy().view(np.uint64), found.column(value).to_numpy())


def _counted(texts: DataFrame, level: int, buckets: int, total: int, heavy: _Table | None, kept: _Filter | None, shorter: _Table | None) -> DataFrame:
    share = texts.sparkSession.sparkContext.broadcast
    blocks = texts.mapInArrow(lean(_blocks(level, buckets, total, share((heavy, kept)) if level > 1 else None)), "bucket int, hist binary, low binary, n binary")
    merged = blocks.groupBy("bucket").applyInArrow(_merged(level, share(shorter) if level > 1 else None), "k long, hist long, low long, c long, pl double")
    return staged(merged, f"counts{level}")


# ---- weights


class Automaton:
    """The hot part: words with their base and score, arcs with what they add, and a filter of all other keys."""

    def __init__(self, words: pa.Table, arcs: pa.Table, others: _Filter, unseen: float, levels: int):
        col = lambda t, c: t.column(c).to_numpy()
        self.words = _Table(col(words, "k").view(np.uint64), col(words, "base"), col(words, "score"))
        self.arcs = _Table(col(arcs, "k").view(np.uint64), col(arcs, "score"))
        self.others, self.unseen, self.levels = others, unseen, levels

    def traverse(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts' tokens: which words are hot, what each token adds to its text's base and score, and the keys that
        may have more outside the hot part, with their tokens' places. Words outside count as unseen here."""
        word = self.words.find(tokens)
        hot = np.flatnonzero(word >= 0)
        base = np.full(len(tokens), self.unseen)
        score = base.copy()
        base[hot], score[hot] = self.words.values[0][word[hot]], self.words.values[1][word[hot]]
        cold = np.flatnonzero(word < 0)
        cold = cold[self.others.passes(tokens[cold])]
        keys, places = [tokens[cold]], [cold]
        going = np.ones(len(tokens), bool)
        going[at[1:] - 1] = False
        key, where = tokens, np.flatnonzero(going[:-1])  # where runs begin that may be kept
        for level in range(2, self.levels + 1):
            mine = _joined(key[where], key[where + 1])
            arc = self.arcs.find(mine)
            hit = arc >= 0
            score[where[hit]] += self.arcs.values[0][arc[hit]]
            miss = np.flatnonzero(~hit)
            maybe = miss[self.others.passes(mine[miss])]
            keys.append(mine[maybe])
            places.append(where[maybe])
            if level < self.levels:  # a longer run is kept only if both runs in it are
                possible = np.zeros(max(len(key) - 1, 0), bool)
                possible[where[hit]] = possible[where[maybe]] = True
                key = np.zeros(len(possible), np.uint64)
                key[where] = mine
                where = np.flatnonzero(possible[:-1] & possible[1:])
        return word >= 0, base, score, np.concatenate(keys), np.concatenate(places)


def _least_count(table: DataFrame, total: int, rows: int) -> int:
    """The least count c that at most some rows of the table (c) reach; the counts sum to total at most."""
    top = total // rows + 1  # fewer rows can have this count
    least, n = top, 0
    for r in sorted(table.groupBy(F.least("c", F.lit(top)).alias("c")).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > rows:
            break
        least = r["c"]
    return least


def fit(train: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, Automaton, int, int]:
    """Blocks (bucket, k, base, score) of the values of words and arcs (without base) outside the hot part, the hot part, the
    number of tokens and that of buckets."""
    spark = train.sparkSession
    texts = train.select(text_or_empty(train).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    buckets = 1 + size // BUCKET_BYTES
    words = _counted(texts, 1, buckets, 0, None, None, None)
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    denominator, unseen = float(total + ALPHA * (distinct + 1)), float(np.log10(ALPHA / (total + ALPHA * (distinct + 1))))
    p = (F.col("c") + ALPHA) / F.lit(denominator)
    shorter, kept, done = words.select("k", "c", p.alias("p"), F.log10(p).alias("own")), None, []
    used = [words]
    for level in range(2, levels + 1):
        heavy = _table(shorter.where(F.col("c") * buckets >= total) if buckets > 1 else shorter.limit(0), "c")  # a row a bucket at most
        frequent = _table(shorter.where(F.col("c") >= _least_count(shorter, total, HOT_WORDS)), "p")
        raw = _counted(texts, level, buckets, total, heavy, kept, frequent)
        held = raw.groupBy(F.col("hist").alias("k")).agg((F.sum("c") - DISCOUNT * F.count("*")).alias("held"))
        left = (F.col("c") - F.col("held")) / F.col("c")
        with_states = staged(shorter.join(held, "k", "left").select("k", "c", "own", left.alias("left")), f"states{level}")
        done.append(with_states)
        # the probability of low: known of frequent ones, joined for others
        others = raw.where("pl is null").drop("pl").join(shorter.where(F.col("c") >= LEAST).select(F.col("k").alias("low"), F.col("p").alias("pl")), "low")
        below = staged(others.select("k", "hist", "c", "pl"), f"below{level}").unionByName(raw.where("pl is not null").select("k", "hist", "c", "pl"))
        states = with_states.where("left is not null").select(F.col("k").alias("hist"), F.col("c").alias("ch"), "left")
        fails = F.col("left") * F.col("pl")
        taken = (F.col("c") - DISCOUNT) / F.col("ch") + fails
        arcs = below.join(small(states, states.count(), 2 * BROADCAST_ROWS), "hist").select("k", "c", taken.alias("p"), (F.log10(taken) - F.log10(fails)).alias("own"))
        shorter = staged(arcs, f"arcs{level}")
        discard(raw, *used)
        used = [shorter]
        if level < levels:
            kept = _Filter(shorter.select("k"), shorter.count())
    value = F.col("own") + F.coalesce(F.log10("left"), F.lit(0.0))
    words = done[0].select("k", "c", F.col("own").alias("base"), value.alias("score"))
    arcs = shorter.select("k", "c", F.col("own").alias("score"))  # nothing is longer, so these begin no arcs
    for d in done[1:]:
        arcs = arcs.unionByName(d.select("k", "c", value.alias("score")))
    often, hot = F.col("c") >= _least_count(words, total, HOT_WORDS), F.col("c") >= _least_count(arcs, total * levels, HOT_ARCS)
    rare = words.where(~often).select("k", (F.col("base") - unseen).alias("base"), (F.col("score") - unseen).alias("score"))
    cold = arcs.where(~hot).select("k", F.lit(None).cast("double").alias("base"), "score")
    blocks = "bucket int, k binary, base binary, score binary"
    rest = staged(rare.mapInArrow(lean(_packed(buckets)), blocks).unionByName(cold.mapInArrow(lean(_packed(buckets)), blocks)), "rest")
    keys = rare.select("k").unionByName(cold.select("k"))
    others = _Filter(keys, keys.count())
    automaton = Automaton(words.where(often).select("k", "base", "score").toArrow(), arcs.where(hot).select("k", "score").toArrow(), others, unseen, levels)
    discard(*done, shorter)
    return rest, automaton, total, buckets


def _packed(buckets: int, rows: int = 1 << 19):
    """Values (k, base, score) of a partition as blocks of buckets; base is null for all or none of them."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from _packed_blocks(held, buckets)
                held, n = [], 0
        if n:
            yield from _packed_blocks(held, buckets)

    return run


def _packed_blocks(batches, buckets: int):
    t = pa.Table.from_batches(batches)
    key = t.column("k").to_numpy().view(np.uint64)
    order = np.argsort(key)
    base = np.zeros(0) if t.column("base").null_count else t.column("base").to_numpy()[order]
    key, score = key[order], t.column("score").to_numpy()[order]
    bucket = _bucket(key, buckets)
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    yield pa.record_batch([pa.array(bucket[edge[:-1]], pa.int32()), *(_cut(x, edge if len(x) else 0 * edge) for x in (key, base, score))], ["bucket", "k", "base", "score"])


# ---- scores

_SCORED = "part long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bucket int, keys binary, docs binary"
_NAMES = [f.split()[0] for f in _SCORED.split(", ")]


def _score(model, buckets: int):
    """Rows of texts (place in their part) with what the hot part gives, and blocks of keys to look up for a part."""

    def run(batches):
        automaton = model.value
        for b in _parts(batches, 3, SCORED_PART):
            tokens, at = _tokens(b.column(3))
            hot, base, score, keys, places = automaton.traverse(tokens, at)
            n, part = b.num_rows, b.column(0)[0].as_py()
            sums = lambda x: np.add.reduceat(x, at[:-1]).astype(float)  # noqa: B023, E731
            none = lambda kind, size: pa.nulls(size, kind)
            yield pa.record_batch([
                pa.array(np.full(n, part)), pa.array(np.arange(n, dtype=np.int32)), b.column(1), b.column(2), pa.array(np.diff(at)), pa.array(sums(hot.astype(np.int64)).astype(np.int64)), pa.array(sums(base)), pa.array(sums(score)),
                pa.array(np.full(n, -1, np.int32)), none(pa.binary(), n), none(pa.binary(), n),
            ], _NAMES)
            order = np.argsort(keys)
            keys, docs = keys[order], (np.searchsorted(at, places[order], side="right") - 1).astype(np.uint32)
            bucket = _bucket(keys, buckets)
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            n = len(edge) - 1
            yield pa.record_batch([
                pa.array(np.full(n, part)), none(pa.int32(), n), none(pa.int64(), n), none(pa.bool_(), n), none(pa.int64(), n), none(pa.int64(), n), none(pa.float64(), n), none(pa.float64(), n),
                pa.array(bucket[edge[:-1]], pa.int32()), _cut(keys, edge), _cut(docs, edge),
            ], _NAMES)

    return run


def _look(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each part of a bucket: the texts that have more, and how much of base, score and known words."""
    base = [np.frombuffer(x.as_buffer()) for x in known.column("base")]
    sizes = [len(x.as_buffer()) // 8 for x in known.column("k")]
    word = np.concatenate([np.zeros(0), *(np.full(n, float(len(b) > 0)) for b, n in zip(base, sizes, strict=True))])
    base = np.concatenate([np.zeros(0), *(b if len(b) else np.zeros(n) for b, n in zip(base, sizes, strict=True))])
    table = _Table(_whole(known.column("k")), base, _whole(known.column("score"), np.float64), word)
    out = [_found_in(table, asked.slice(a, z - a)) for a, z in _spans(asked.column("keys"))]
    return pa.concat_tables(out) if out else _found_in(table, asked)


def _spans(column: pa.ChunkedArray, limit: int = ASKED_BYTES):
    """Ranges of rows with about limit bytes."""
    ends = np.cumsum(np.array([len(x.as_buffer()) for x in column], np.int64))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, z
        a = z


def _found_in(table: _Table, asked: pa.Table) -> pa.Table:
    """What rows of one bucket find, a row for each part that finds something; all rows' keys are looked up together."""
    at = table.find(_whole(asked.column("keys")))
    sizes = np.array([len(x.as_buffer()) // 8 for x in asked.column("keys")], np.int64)
    hit = np.flatnonzero(at >= 0)
    doc = (np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | _whole(asked.column("docs"), np.uint32).astype(np.uint64))[hit]
    doc, which = np.unique(doc, return_inverse=True)
    base, score, n = (np.bincount(which, weights=v[at[hit]], minlength=len(doc)) for v in table.values)
    row = (doc >> np.uint64(32)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    cut = [_cut(x, edge) for x in (doc.astype(np.uint32), base.astype(float), score.astype(float), n.astype(np.uint32))]
    return pa.table([pa.array(asked.column("part").to_numpy()[row[edge[:-1]]], pa.int64()), *cut], names=["part", "docs", "base", "score", "known"])


def _added(rows: pa.Table, more: pa.Table) -> pa.Table:
    """A part's rows with what the lookups found."""
    place = rows.column("place").to_numpy()
    docs = _whole(more.column("docs"), np.uint32)
    size = int(max(place.max(initial=-1), docs.max(initial=0)) + 1) if len(docs) else int(place.max(initial=-1) + 1)
    add = {c: np.bincount(docs, weights=_whole(more.column(c), kind).astype(float), minlength=size)[place] if len(docs) else np.zeros(len(place)) for c, kind in (("base", np.float64), ("score", np.float64), ("known", np.uint32))}
    known = rows.column("n_known").to_numpy() + add["known"].astype(np.int64)
    return pa.table([rows.column("doc_id"), rows.column("held_out"), rows.column("n_tokens"), pa.array(known), pa.array(rows.column("base").to_numpy() + add["base"]), pa.array(rows.column("score").to_numpy() + add["score"])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, train: DataFrame, held_out=None, levels: int = LEVELS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are the words, A-Z lower-cased, and one end; a null text has the end alone, and a text of any length is read
    whole. base_score is the smoothed unigram log10 probability, score the automaton's with n-grams of up to `levels`
    tokens. Rows that repeat are scored
    alike; extra columns are ignored; without training rows every token has the probability of an unseen one; an empty
    table gives none.
    """
    spark = docs.sparkSession
    rest, automaton, total, buckets = fit(train, levels)
    model = spark.sparkContext.broadcast(automaton)
    held = F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False))
    text = text_or_empty(docs)
    every = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(WAVES)).alias("wave"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"))
    out = None
    for wave in range(WAVES):
        rows = every.where(F.col("wave") == wave).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
        scored = staged(rows.mapInArrow(lean(_score(model, buckets)), _SCORED), "scored")
        asked = scored.where("bucket >= 0").select("part", "bucket", "keys", "docs")
        found = staged(asked.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(_look, "part long, docs binary, base binary, score binary, known binary"), "found")
        done = scored.where("bucket < 0").drop("bucket", "keys", "docs").groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        done = staged(done, "wave")
        discard(scored, found)
        out = done if out is None else out.unionByName(done)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = learned_crc("doc_id", 10) == 0
    return score_texts(docs, docs.where(~held), held)

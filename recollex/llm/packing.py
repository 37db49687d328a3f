"""Best-fit packing: patterns of few lengths, fitted to the length histogram by non-negative least squares.

Documents become token ids, and pieces of at most CAPACITY ids. Only the histogram of piece lengths (CAPACITY numbers)
reaches the driver. There, patterns of one to three lengths that fill a sequence are enumerated, their repeat counts
are fitted to the histogram by NNLS and rounded down, and best-fit decreasing packs what is left, length by length. The
plan says, for the k-th piece of a length, its sequence and offset; its size depends on CAPACITY, not on the input.
Pieces get their k by salted ranks, so a very common length is no bottleneck.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm import _hashing as H
from recollex.llm._shared import lean, small, staged, text_or_empty

CAPACITY, TOKENIZER, END_ID = 2048, "word_bpe_49k.json", 0
#: Units that a Python worker remembers, and their ids, at most (some 40 MB); beyond it starts anew.
CACHED_UNITS, CACHED_IDS = 1_000_000, 4_000_000
#: Bytes of text that are encoded at a time, about; a longer text is encoded alone.
BLOCK_BYTES = 1_000_000
#: Pieces of one length that are ranked in one group, about; a common length has as many groups as it needs.
RANK_GROUP = 200
#: Groups whose counts are added up together; the sums of such ranges are added up once more.
RANGE_GROUPS = 1024
MAX_PATTERNS, NNLS_STEPS = 2_200_000, 60


# ---- tokens

#: Classes of bytes: white space, letters, digits, marks, and what makes a word irregular: apostrophes (contractions),
#: angles (special tokens), control characters and all that is outside ASCII, but for the letters of U+00C0 to U+00FF.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[0x21:0x7F] = MARK
for _first, _last in (b"AZ", b"az"):
    _CLASS[_first : _last + 1] = LETTER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[ord("'"), ord("<")]] = ODD
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _latin_letters(data: np.ndarray) -> np.ndarray:
    """First bytes of the letters U+00C0 to U+00FF (without the signs of times and division)."""
    first = np.flatnonzero(data[:-1] == 0xC3)
    second = data[first + 1]
    return first[(second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the tokenizer handles on its own: starts and ends of units, whether each is regular, and the bytes in lower
    case where that is regular. A regular word is cut where the tokenizer's pattern cuts it: runs of letters, single
    digits, runs of marks. An irregular word is one unit."""
    kind = _CLASS[data]
    low = _LOWER[data]
    latin = _latin_letters(data)
    kind[latin] = kind[latin + 1] = LETTER
    upper = latin[(data[latin + 1] >= 0x80) & (data[latin + 1] <= 0x9E)]
    low[upper + 1] += 32
    ws, we = H.word_spans(data, offsets)
    odd = np.zeros(len(ws), bool)
    odd[np.searchsorted(ws, np.flatnonzero(kind == ODD), side="right") - 1] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut[ws] = True
    word = np.flatnonzero(odd)
    inside = np.zeros(len(data) + 1, np.int8)  # places within an irregular word aren't cut
    inside[ws[word] + 1] += 1
    np.subtract.at(inside, we[word], 1)
    cut[:-1] &= (kind != SPACE) & (np.cumsum(inside[:-1], dtype=np.int8) == 0)
    starts = np.flatnonzero(cut[:-1])
    of = np.searchsorted(ws, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), we[of])
    return starts, ends, ~odd[of], low


def _gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of source that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Encoder:
    """Ids of texts. The tokenizer's pieces never reach over ASCII white space, and a regular word falls into units that
    it handles apart; so ids of a text are the joined ids of its units. Distinct units are encoded once a block, and
    remembered by their hashes while there is room."""

    MARK = "<|endoftext|>"
    SUFFIX = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(self.MARK)
        # for regular units, which are in lower case and cut already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(self.SUFFIX)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        """The text's ids; the batch call keeps no offsets, which saves time."""
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _regular(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular units and how many each has: the units in one text, each of which ends with a token that has
        the suffix of word ends."""
        size = ends - starts
        text = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        to = np.cumsum(size + 1) - size - 1
        text[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())] = _gathered(low, starts, size)
        ids = self._ids(self.plain, text.tobytes().decode())
        stops = np.flatnonzero(self.last[ids])
        assert len(stops) == len(starts)
        return ids, np.diff(stops, prepend=-1)

    def _irregular(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of irregular words. They go to the tokenizer in one text, held apart by a special token; words that
        may hold one go alone."""
        out = [np.zeros(0, np.uint32)] * len(words)
        together = [i for i, w in enumerate(words) if b"<|" not in w] if self.mark is not None else []
        for i in set(range(len(words))) - set(together):
            out[i] = self._ids(self.tokenizer, words[i].decode())
        for a in range(0, len(together), 4096):
            part = together[a : a + 4096]
            ids = self._ids(self.tokenizer, self.MARK.join(words[i].decode() for i in part))
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(part) - 1
            for i, x in zip(part, np.split(ids, cuts), strict=True):
                out[i] = x[1:] if i != part[0] else x
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and n + 1 offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, regular, low = _units(data, offsets)
        h = np.empty(len(starts), np.uint64)
        h[regular] = H.span_hashes(low, starts[regular], ends[regular])
        h[~regular] = H.mix(H.span_hashes(data, starts[~regular], ends[~regular]) ^ np.uint64(0x452821E638D01377))
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_UNITS or len(self.flat) > CACHED_IDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            at_new, key = first[new], unique[new]
            plain = regular[at_new]
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            ids, sizes = zip(self._regular(low, starts[at_new[plain]], ends[at_new[plain]]), self._irregular([data[starts[k] : ends[k]].tobytes() for k in at_new[~plain]]), strict=True)
            size = np.empty(len(key), np.int64)
            size[order] = np.concatenate(sizes)
            place = np.empty(len(key), np.int64)
            place[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
            self.flat = np.concatenate([self.flat, *ids])
            where = np.searchsorted(self.keys, key)
            self.keys, self.starts, self.sizes = (np.insert(x, where, y) for x, y in ((self.keys, key), (self.starts, place), (self.sizes, size)))
            at = np.searchsorted(self.keys, unique)
        at = at[which]
        sizes = self.sizes[at]
        ids = _gathered(self.flat, self.starts[at], sizes)
        return ids, np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]


@functools.cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _pieces(path: str, capacity: int):
    def run(batches):
        encode = _encoder(path)
        for b in batches:
            data, offs = H.text_buffers(b.column(1))
            for lo, hi in H.chunks_of(offs, BLOCK_BYTES):
                ids, at = encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                raw = np.insert(ids, at[1:], END_ID).astype("<u4").tobytes()
                at = at + np.arange(len(at))
                n = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[doc] - start)
                first = 4 * (at[:-1][doc] + start)
                sums = [zlib.crc32(raw[s : s + k]) for s, k in zip(first.tolist(), (4 * length).tolist(), strict=True)]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.forget()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each row's text and the end id, cut every capacity ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(lean(_pieces(tokenizer_path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- plan


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of one to three of the given lengths (0: none), each of which fills a sequence as far as the lengths allow:
    the last length is the largest that still fits."""
    lengths = np.sort(lengths)
    if not len(lengths):
        return np.zeros((0, 3), np.int64)

    def fill(room: np.ndarray, most: np.ndarray) -> np.ndarray:
        i = np.searchsorted(lengths, np.minimum(room, most), side="right") - 1
        return np.where(i >= 0, lengths[np.maximum(i, 0)], 0)

    one = np.stack([lengths, 0 * lengths, 0 * lengths], 1)
    two = np.stack([lengths, fill(capacity - lengths, lengths), 0 * lengths], 1)
    step = max(1, int(np.ceil(len(lengths) ** 2 / 2 / MAX_PATTERNS)))
    a = lengths
    i, j = np.tril_indices(len(a))
    i, j = i[::step], j[::step]
    third = fill(capacity - a[i] - a[j], a[j])
    three = np.stack([a[i], a[j], third], 1)[third > 0]
    return np.unique(np.concatenate([one, two[two[:, 1] > 0], three]), axis=0)[:, ::1]


def fit_counts(pats: np.ndarray, hist: np.ndarray, capacity: int) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: least squares, in which the waste of a
    pattern counts as well, by accelerated projected gradient."""
    at = [pats[:, k] for k in range(3)]
    used = pats > 0
    waste = 1 - pats.sum(1) / capacity

    def lengths_of(x):
        out = np.zeros(capacity + 1)
        for k in range(3):
            out += np.bincount(at[k], weights=x * used[:, k], minlength=capacity + 1)[: capacity + 1]
        return out

    scale = max(hist.max(), 1)
    goal = hist / scale
    x = np.zeros(len(pats))
    y, t = x.copy(), 1.0
    # Lipschitz constant: the largest row times the largest column sum
    most = 3 * max(1.0, lengths_of(np.ones(len(pats))).max())
    for _ in range(NNLS_STEPS):
        miss = lengths_of(y) - goal
        grad = sum(np.where(used[:, k], miss[at[k]], 0) for k in range(3)) + 1e-3 * waste
        new = np.maximum(0, y - grad / most)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) whose lengths add up to the histogram: fitted patterns, rounded down to what is there, and
    best-fit decreasing for the rest."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, tuple[int, ...]]] = []
    pats = patterns(np.flatnonzero(left), capacity)
    if len(pats):
        x = np.floor(fit_counts(pats, left.astype(float), capacity) + 1e-9).astype(np.int64)
        fullest = np.lexsort((-x, -pats.sum(1)))
        for p in fullest[x[fullest] > 0]:
            need = Counter(int(v) for v in pats[p] if v)
            n = min(int(x[p]), *(int(left[v]) // k for v, k in need.items()))
            if n > 0 and sum(v * k for v, k in need.items()) >= capacity - 1:
                for v, k in need.items():
                    left[v] -= n * k
                out.append((n, tuple(int(v) for v in pats[p] if v)))
    return out + best_fit_decreasing(left, capacity)


def best_fit_decreasing(hist: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit over a histogram: pieces in order of falling length go to the fullest sequence with room. Sequences with
    equal contents are handled together, so the work depends on the lengths there are, not on the number of pieces."""
    left = hist.astype(np.int64).copy()
    open_: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = np.zeros(capacity + 1, np.int64)
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            fits = np.flatnonzero(rooms[v:])
            if len(fits):
                room = v + int(fits[0])
                count, content = open_[room].pop()
                rooms[room] -= 1
                k = min(n, count)
                if count > k:
                    open_[room].append((count - k, content))
                    rooms[room] += 1
                open_[room - v].append((k, (*content, v)))
                rooms[room - v] += 1
                n -= k
            else:
                per = capacity // v
                k, rest = divmod(n, per)
                if k:
                    open_[capacity - per * v].append((k, (v,) * per))
                    rooms[capacity - per * v] += 1
                if rest:
                    open_[capacity - rest * v].append((1, (v,) * rest))
                    rooms[capacity - rest * v] += 1
                n = 0
    return [x for group in open_ for x in group]


def segments(planned: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """The plan by length: rows (length, first rank, first sequence, offset); ranks of a segment take one sequence each,
    up to the next segment's first rank. Sorted by length, then rank."""
    rows, sequence, rank = [], 0, Counter()
    for n, lengths in planned:
        offset = 0
        for v in lengths:
            rows.append((v, rank[v], sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _placed(table):
    def run(batches):
        seg = table.value
        key = (seg[:, 0] << 48) + seg[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seg[at, 2] + rank - seg[at, 1]), pa.array(seg[at, 3])], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: sequences are filled from 0 without
    gaps, to at most capacity. Repeated rows are pieces of their own; an empty table gives none."""
    spark = pieces.sparkSession
    pieces = staged(pieces, "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator():  # capacity rows at most
        hist[r["length"]] = r["n"]
    salts = F.get(F.split(F.lit(",".join(map(str, 1 + hist // RANK_GROUP))), ",").cast("array<long>"), F.col("length").cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("range", F.expr(f"salt div {RANGE_GROUPS}"))
    groups = staged(groups, "groups")
    table = spark.sparkContext.broadcast(segments(plan(hist, capacity)))
    # pieces of a length in earlier ranges, and in earlier groups of the range: no task has a length's groups alone
    ranges = groups.groupBy("length", "range").agg(F.sum("n").alias("n"))
    ranges = staged(ranges.select("length", "range", (F.expr("sum(n) OVER (PARTITION BY length ORDER BY range)") - F.col("n")).alias("first")), "ranges")
    within = F.expr("sum(n) OVER (PARTITION BY length, range ORDER BY salt)") - F.col("n")
    before = groups.withColumn("within", within).join(small(ranges, ranges.count()), ["length", "range"]).select("length", "salt", (F.col("first") + F.col("within")).alias("before"))
    ranked = salted.withColumn("own", F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece, ids_crc32) - 1"))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    return ranked.mapInArrow(lean(_placed(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of docs (doc_id, text) with its place. Null text is empty and has the end id alone; a null doc_id
    stays null; a very long text is encoded alone and cut into pieces; pieces of one length that tie for a place are dealt
    by doc_id, piece and ids; repeated rows are pieces of their own; extra columns are ignored; an empty table gives
    none."""
    return pack(token_pieces(docs, tokenizer_path or _default_path(), capacity), capacity)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

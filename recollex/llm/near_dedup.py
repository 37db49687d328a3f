"""MinHash near-dedup with SetSketch registers.

1. Every document's set of word shingles becomes REGISTERS registers: exponentially spaced, truncated minima of one hash
   per register. They are mergeable (by maximum) and locality-sensitive. Documents with equal sets form a class, which
   goes on as one.
2. Bands of ROWS register values are bucket keys. Classes whose sets overlap by 80 % share one of BANDS bands but for
   (1 - 0.8**ROWS)**BANDS = 3e-6 of them.
3. In each bucket the class that meets most others (the sum of its buckets' sizes) is the hub. Each class is tested
   with its best hub: the similarity is estimated jointly from both sketches by likelihood, then verified on full sets.
   In a group of copies of one text nearly all link to that text, so no pairs are listed.
4. Buckets that still hold different components are compared pair by pair in blocks of bounded size, each pair in its
   first common band only: estimate, then full sets. A block returns a spanning forest of its links.
5. Components by label propagation with pointer jumping, each round in a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm import _hashing as H
from recollex.llm._shared import discard, lean, small, staged, text_or_empty

ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
#: SetSketch's base and rate: registers are floor(1 - log_BASE(x)) of minima x of exponentials with rate RATE.
BASE, RATE, TOP = 1.02, 20.0, 65_535
SHINGLE, PERCENT = 4, 80
#: Estimates below this aren't verified; for a true 0.8 that is 4.4 standard deviations.
LEAST_ESTIMATE = 0.66
#: Classes of a bucket that are compared at once.
BLOCK = 512
NULL_ID = -(2**63)

_rng = np.random.default_rng(97)
_MULTIPLIERS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for a in range(0, len(hashes), 256):
        part = (hashes[a : a + 256, None] ^ _SHIFTS) * _MULTIPLIERS
        np.minimum(least, part.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band of each row of registers."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    h = np.broadcast_to(h, (len(regs), BANDS))
    for k in range(ROWS):
        h = H.mix(h ^ parts[:, :, k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return h


_GRID = np.linspace(0.4, 1.0, 61)


def estimated_similarity(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity (of a grid) under which the counts of equal, larger and smaller registers are likeliest,
    given the set sizes."""
    equal, above, below, n_u, n_v = (np.asarray(x, float)[:, None] for x in (equal, above, below, n_u, n_v))
    u = n_u / (n_u + n_v)
    j = np.minimum(_GRID[None, :], np.minimum(n_u / n_v, n_v / n_u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
    like = above * np.log(more + 1e-12) + below * np.log(less + 1e-12) + equal * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document; of fewer words the whole sequence, of none nothing."""
    return np.unique(H.gram_hashes(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _sets(batches, shingle: int):
    """(ids, sets) of chunks of (doc_id, text)."""
    for b in batches:
        data, offs = H.text_buffers(b.column(1))
        for lo, hi in H.chunks_of(offs):
            words, w = H.hashed_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], True)
            grams = H.gram_hashes(words, shingle)
            out = []
            for i in range(hi - lo):
                a, z = w[i], w[i + 1]
                out.append(np.unique(grams[a : z - shingle + 1]) if z - a >= shingle else shingle_set(words[a:z], shingle))
            yield b.column(0).slice(lo, hi - lo), out


def _set_hashes(sets) -> tuple[np.ndarray, np.ndarray]:
    s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    return s1, np.array([H.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)


def _sketches(shingle: int):
    def run(batches):
        for ids, sets in _sets(batches, shingle):
            n = np.array([len(s) for s in sets], np.int64)
            s1, s2 = _set_hashes(sets)
            regs = [registers(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.record_batch([ids, pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "n", "s1", "s2", "regs"])

    return run


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (shingles), s1 and s2 (hash of the set), regs (registers) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(lean(_sketches(shingle)), "doc_id long, n long, s1 long, s2 long, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    data, offs = column.buffers()[2], column.offset
    n = len(column)
    return np.frombuffer(data, np.uint16)[offs * REGISTERS : (offs + n) * REGISTERS].reshape(n, REGISTERS) if n else np.zeros((0, REGISTERS), np.uint16)


def _keys(batches):
    for b in batches:
        keys = band_keys(_matrix(b.column(1))).view(np.int64)
        yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(keys.ravel())], ["rep", "band", "key"])


def _likely(batches):
    """Pairs with both sketches: those that may be similar enough."""
    for b in batches:
        a, z = _matrix(b.column(4)), _matrix(b.column(5))
        n = [b.column(k).to_numpy() for k in (2, 3)]
        keep = estimated_similarity((a == z).sum(1), (a > z).sum(1), (a < z).sum(1), *n) >= LEAST_ESTIMATE
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:4]], names=["a", "b", "na", "nb"])


def _set_rows(shingle: int):
    def run(batches):
        for _, sets in _sets(batches, shingle):
            s1, s2 = _set_hashes(sets)
            yield pa.record_batch([pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "set"])

    return run


def _set_of(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _verified(percent: int):
    def run(batches):
        for b in batches:
            keep = [_similar(_set_of(x.as_buffer()), _set_of(y.as_buffer()), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return run


class _Block:
    """Candidate pairs of a block of a bucket: of different components, in their first common band, likely similar."""

    def __init__(self, table: pa.Table, i: int, j: int):
        t = table.combine_chunks()
        col = lambda c: t.column(c).combine_chunks() if t.num_rows else t.column(c)
        self.rep, self.lab, self.n, self.blk = (t.column(c).to_numpy() for c in ("rep", "lab", "n", "blk"))
        regs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in col("regs")])
        band = int(t.column("band")[0].as_py())
        first, second = np.flatnonzero(self.blk == i), np.flatnonzero(self.blk == j)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for a in first:
            z = second[second > a] if i == j else second
            z = z[self.lab[z] != self.lab[a]]
            if not len(z):
                continue
            same = regs[z] == regs[a]
            shared = same.reshape(len(z), BANDS, ROWS).all(2)
            z, same = z[shared.argmax(1) == band], same[shared.argmax(1) == band]
            if len(z):
                e = estimated_similarity(same.sum(1), (regs[z] < regs[a]).sum(1), (regs[z] > regs[a]).sum(1), np.full(len(z), self.n[a]), self.n[z])
                z = z[e >= LEAST_ESTIMATE]
                if len(z):
                    self.pairs.append((np.full(len(z), a), z))
        self.a = np.concatenate([p[0] for p in self.pairs]) if self.pairs else np.zeros(0, int)
        self.z = np.concatenate([p[1] for p in self.pairs]) if self.pairs else np.zeros(0, int)


_MEMBER = "key long, i int, j int, band int, rep long, lab long, n long, blk int, regs binary"


def _involved(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    block = _Block(table, key[1].as_py(), key[2].as_py())
    return table.take(pa.array(np.unique(np.concatenate([block.a, block.z])).astype(np.int64))).select([f.split()[0] for f in _MEMBER.split(", ")])


def _forest(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(table, key[1].as_py(), key[2].as_py())
        sets = [_set_of(x.as_buffer()) for x in table.column("set").combine_chunks()]
        root = {int(v): int(v) for v in block.lab}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out: list[tuple[int, int]] = []
        for a, z in zip(block.a, block.z, strict=True):
            x, y = find(int(block.lab[a])), find(int(block.lab[z]))
            if x != y and _similar(sets[a], sets[z], percent):
                root[max(x, y)] = min(x, y)
                out.append((int(block.rep[a]), int(block.rep[z])))
        return pa.table([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, lab): the smallest id that each linked id reaches over links (a, b). Labels pass to neighbours and jump along
    pointers until nothing changes; the rounds grow with the logarithm of the longest path, and none of it leaves the executors."""
    both = staged(links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("lab")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("to"), F.col("lab").alias("far")), "to").groupBy("id").agg(F.min("far").alias("far"))
        new = labels.select("id", "lab").join(seen, "id").select("id", F.col("lab").alias("old"), F.least("lab", "far").alias("lab"))
        jump = labels.select(F.col("id").alias("lab"), F.col("lab").alias("up"))
        new = staged(new.join(jump, "lab", "left").select("id", "old", F.least("lab", F.coalesce("up", F.col("lab"))).alias("lab")), "labels")
        discard(labels)
        labels = new
        if labels.where("lab <> old").limit(1).count() == 0:
            discard(both)
            return labels.select("id", "lab")


def near_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes (rep, s1, s2, least, n, regs) that join every component."""
    keys = classes.select("rep", "regs").mapInArrow(lean(_keys), "rep long, band int, key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(keys.join(shared, "key"), "members")
    popular = members.groupBy("rep").agg(F.sum("size").alias("pop"))
    ranked = members.join(popular, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("neg"))).alias("hub"))
    # each class with the best hub of its buckets; a class that is its own best hub waits for others
    best = ranked.join(hubs, "key").groupBy("rep").agg(F.max("hub").alias("hub")).select(F.col("rep").alias("a"), (-F.col("hub.neg")).alias("b")).where("a <> b")
    needed = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "s1", "s2", "least")
    side = lambda d, c: d.select(F.col("rep").alias(c), F.col("n").alias("n" + c), F.col("regs").alias("r" + c))
    likely = best.join(side(classes, "a"), "a").join(side(classes, "b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lean(_likely), "a long, b long, na long, nb long")
    needed = staged(needed, "needed")
    n = needed.count()
    ids, needed = small(needed.select(F.col("least").alias("doc_id")).distinct(), n), small(needed, n)
    # of rows that share a doc_id, each is looked at; a set goes to the class of its own hash
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_or_empty(docs).alias("text"))
    texts = texts.join(ids, "doc_id", "left_semi").select("doc_id", "text")
    found = texts.mapInArrow(lean(_set_rows(shingle)), "s1 long, s2 long, set binary").join(needed, ["s1", "s2"]).select("rep", "set")
    sets = staged(found.dropDuplicates(["rep"]), "sets")
    of = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias("s" + c))
    first = staged(likely.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(_verified(percent)), "a long, b long"), "links")

    labels = components(first)
    named = members.join(labels.select(F.col("id").alias("rep"), "lab"), "rep", "left").withColumn("lab", F.coalesce("lab", "rep"))
    mixed = named.groupBy("key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo <> hi").select("key")
    rest = named.join(mixed, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rest = rest.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "band", "rep", "lab", "blk").join(classes.select("rep", "n", "regs"), "rep")
    rest = rest.select(*[f.split()[0] for f in _MEMBER.split(", ")])
    involved = rest.groupBy("key", "i", "j").applyInArrow(_involved, _MEMBER)
    second = involved.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(_forest(percent), "a long, b long")
    return staged(first.unionByName(second), "links")


def _same_id(every: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id. Null ids need none: each of their classes has the
    smallest id anyway."""
    by = every.where((F.col("n") > 0) & (F.col("doc_id") != NULL_ID)).select("doc_id", F.struct("s1", "s2").alias("s"))
    shared = staged(by.groupBy("doc_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("doc_id"), "shared")
    rows = by.join(small(shared, shared.count()), "doc_id", "left_semi").select("doc_id", "s.s1", "s.s2").distinct()
    rows = staged(rows.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep"), "shared")
    first = rows.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return rows.join(first, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Links hold between sets with 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    Null, empty and word-less texts have no shingles and stand alone; shorter texts than a shingle are one shingle.
    Rows that share a doc_id count as one node; a null doc_id is a node smaller than all, given as null. Extra columns
    are ignored; an empty table gives none.
    """
    every = staged(sketches(docs, shingle).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))), "sketches")
    classes = every.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("regs").alias("regs"))
    # numbered and written: the numbers stay, and joins are plain exchanges on both sides, which Spark splits at a hot hub
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = near_links(docs, classes, shingle, percent).unionByName(_same_id(every, classes))
    labels = components(links)
    named = labels.join(classes.select(F.col("rep").alias("id"), "least"), "id")
    tops = staged(named.groupBy("lab").agg(F.min("least").alias("top")), "tops")
    tops = labels.join(small(tops, tops.count()), "lab").select(F.col("id").alias("rep"), "top")
    of_class = staged(classes.select("s1", "s2", "rep", "least").join(tops, "rep", "left").select("s1", "s2", F.coalesce("top", "least").alias("lab")), "components")
    of_class = small(of_class, of_class.count())
    out = every.join(of_class, ["s1", "s2"], "left").withColumn("lab", F.when(F.col("n") > 0, F.coalesce("lab", "doc_id")).otherwise(F.col("doc_id")))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("lab").alias("component_id"), (F.col("doc_id") == F.col("lab")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest, with all their columns."""
    gone = staged(near_duplicates(docs, shingle, percent).where("not kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("gone")).distinct(), "gone")
    gone = small(gone, gone.count())
    return docs.join(gone, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == gone["gone"], "left_anti")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

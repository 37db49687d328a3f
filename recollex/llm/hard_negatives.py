"""Hard-negative mining by dual-tree search over integer inner products.

Rows are dealt to the leaves of a coarse tree (fitted on a bounded sample, which decides nothing but speed); a leaf with
many rows is split further by hashed ids. What comes out are blocks of some BLOCK rows, each stored in the order of a
tree of its own: halves by label first, so that nodes become pure, then by the widest dimension. Anchors get blocks and
trees alike. They are searched in waves of some WAVE rows, whose trees are broadcast; every task walks pairs of an
anchor node and a candidate node. The boxes of two nodes bound all their inner products from both sides, so a pair
goes, with all its anchors at once, if the upper end is below what each of them has found or may take, if the lower end
is above what they may take, or if the labels can't fit. Pairs of leaves that are left are scored exactly, the best
first. Tasks return k rows for each search; Spark ranks those.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.llm._shared import discard, lean, staged

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH per cent of the positive's.
LOW, HIGH = 30, 90
#: Rows of a block and of a wave of anchors, about; rows of a tree's leaf, at most.
BLOCK, WAVE, LEAF = 2048, 16_384, 64
#: Rows that the coarse tree is fitted on, and its leaves, at most.
SAMPLE, MOST_LEAVES = 4096, 4096
#: Node pairs that are bounded at once; found scores that are gathered before they are ranked.
PAIRS, FOUND = 8192, 1 << 17
_LEAST, _MOST = -(2**63), 2**63 - 1


# ---- blocks


def _coarse(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimension, cut) of all nodes of each level: the widest dimension at its median."""
    parts, levels = [sample], []
    for _ in range(depth):
        dims = np.array([int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0 for p in parts])
        cuts = np.array([np.median(p[:, d]) if len(p) else 0.0 for p, d in zip(parts, dims, strict=True)])
        levels.append((dims, cuts))
        parts = [q for p, d, c in zip(parts, dims, cuts, strict=True) for q in (p[p[:, d] <= c], p[p[:, d] > c])]
    return levels


def _leaf_of(x: np.ndarray, levels) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for dims, cuts in levels:
        at = 2 * at + (x[np.arange(len(x)), dims[at]] > cuts[at])
    return at


def _matrix(column) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _in_tree_order(labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Order of the rows in which halving again and again gives the tree's nodes."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        rows = order[a:b]
        lab = labels[rows]
        if lab.min() != lab.max():
            key = lab
        else:
            part = x[rows]
            key = part[:, int(np.argmax(part.max(0) - part.min(0)))] if x.shape[1] else lab
        order[a:b] = rows[np.argsort(key, kind="stable")]
        m = (a + b) // 2
        todo += [(a, m), (m, b)]
    return order


def _packed(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    labels = table.column("label").to_numpy()
    x = _matrix(table.column("x"))
    by_id = np.argsort(ids, kind="stable")
    order = by_id[_in_tree_order(labels[by_id], x[by_id])]
    raw = [np.ascontiguousarray(v[order]).astype("<i8").tobytes() for v in (ids, labels, x)]
    return pa.table({"n": pa.array([len(ids)], pa.int64()), **{c: pa.array([r], pa.binary()) for c, r in zip(("ids", "labels", "x"), raw, strict=True)}})


def _blocks(rows: DataFrame, levels, size: int) -> DataFrame:
    """One row for each block of rows (vec_id, label, x, leaf): n and its packed columns, in tree order."""
    counts = np.zeros(1 << len(levels), np.int64)
    for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).toLocalIterator():  # MOST_LEAVES rows at most
        counts[r["leaf"]] = r["n"]
    salts = F.get(F.split(F.lit(",".join(map(str, 1 + counts // size))), ",").cast("array<long>"), F.col("leaf").cast("int"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts))
    return salted.groupBy("leaf", "salt").applyInArrow(_packed, "n long, ids binary, labels binary, x binary")


def _unpacked(n: int, ids: bytes, labels: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(x, "<i8").reshape(n, -1)


# ---- trees


class Forest:
    """Trees over blocks of rows in tree order. Node arrays: first row and end, children (-1: a leaf), box, labels."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.labels, self.x = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        nodes: list[tuple[int, int]] = []
        left: list[int] = []
        self.roots, at = [], 0
        for b in blocks:
            self.roots.append(len(nodes))
            todo = [(at, at + len(b[0]))]
            while todo:  # level by level, so children stand behind their parents
                below = []
                for lo, hi in todo:
                    nodes.append((lo, hi))
                    left.append(-2 if hi - lo > LEAF else -1)
                    if hi - lo > LEAF:
                        below += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
                todo = below
            at += len(b[0])
        self.first, self.end = np.array(nodes, np.int64).reshape(-1, 2).T
        # children follow in the order of their parents
        self.left = np.array(left, np.int64)
        for root, stop in zip(self.roots, [*self.roots[1:], len(nodes)], strict=True):
            inner = root + np.flatnonzero(self.left[root:stop] == -2)
            self.left[inner] = root + 1 + 2 * np.arange(len(inner))
        self.low, self.high = self.over_nodes(self.x, np.minimum), self.over_nodes(self.x, np.maximum)
        self.least_label, self.most_label = self.over_nodes(self.labels, np.minimum), self.over_nodes(self.labels, np.maximum)
        self.least_id = self.over_nodes(self.ids, np.minimum)

    def over_nodes(self, values: np.ndarray, least, starts: np.ndarray | None = None) -> np.ndarray:
        """least of the values of each node's rows; starts: where each row's values begin, if they have several."""
        begins = self.first if starts is None else starts[self.first]
        ends = self.end if starts is None else starts[self.end]
        leaves = np.flatnonzero(self.left < 0)
        out = np.empty((len(self.first), *values.shape[1:]), values.dtype)
        filled = leaves[ends[leaves] > begins[leaves]]
        out[leaves] = _MOST if least is np.minimum else _LEAST  # of leaves without values
        if len(filled):
            by = filled[np.argsort(begins[filled])]
            out[by] = least.reduceat(values, begins[by], axis=0)
        for k in np.flatnonzero(self.left >= 0)[::-1].tolist():
            c = self.left[k]
            out[k] = least(out[c], out[c + 1])
        return out


def intervals(a: Forest, c: Forest, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that rows in the boxes of the nodes i of a and j of c can have."""
    corners = [p[i].astype(np.float64) * q[j] for p in (a.low, a.high) for q in (c.low, c.high)]
    return reduce(np.minimum, corners).sum(1), reduce(np.maximum, corners).sum(1)


class Search:
    """The best k candidates of each query, a query being an anchor's row with the scores it may take (from, upto)."""

    def __init__(self, anchors: Forest, row: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same_label: bool):
        self.anchors, self.row, self.least, self.most, self.k, self.same = anchors, row, least, most, k, same_label
        self.starts = np.searchsorted(row, np.arange(len(anchors.ids) + 1))  # rows are sorted
        self.scores = np.full((len(row), k), _LEAST)
        self.found = np.full((len(row), k), _MOST)
        self.node_most = anchors.over_nodes(most, np.maximum, self.starts)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.gathered = 0
        self.leaf_pairs = 0

    def need(self) -> np.ndarray:
        """What a score must reach (with a smaller id, at equality) to be of use to a query."""
        return np.maximum(self.least, self.scores[:, -1])

    def _rank(self) -> None:
        """Merges what waits into the best k."""
        if not self.waiting:
            return
        q, s, v = (np.concatenate(w) for w in zip(*self.waiting, strict=True))
        touched = np.unique(q)
        old = self.scores[touched].ravel() != _LEAST
        q = np.concatenate([q, np.repeat(touched, self.k)[old]])
        s = np.concatenate([s, self.scores[touched].ravel()[old]])
        v = np.concatenate([v, self.found[touched].ravel()[old]])
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.scores[touched], self.found[touched] = _LEAST, _MOST
        self.scores[q[top], rank[top]] = s[top]
        self.found[q[top], rank[top]] = v[top]
        self.waiting, self.gathered = [], 0

    def _fits(self, c: Forest, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a = self.anchors
        if self.same:
            return (a.least_label[i] <= c.most_label[j]) & (c.least_label[j] <= a.most_label[i])
        return (a.least_label[i] != a.most_label[i]) | (c.least_label[j] != c.most_label[j]) | (a.least_label[i] != c.least_label[j])

    def _of_use(self, c: Forest, i, j, low, high, need, last_id) -> np.ndarray:
        return (low <= self.node_most[i]) & ((high > need[i]) | (high == need[i]) & (c.least_id[j] < last_id[i]))

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor node, the least that any of its queries needs, and the greatest id that a tie may beat."""
        return self.anchors.over_nodes(self.need(), np.minimum, self.starts), self.anchors.over_nodes(self.found[:, -1], np.maximum, self.starts)

    def visit(self, c: Forest) -> None:
        """All of one candidate block."""
        a = self.anchors
        largest = max(np.abs(a.x).max(initial=0), 1) * max(np.abs(c.x).max(initial=0), 1) if a.x.size and c.x.size else 1
        exact = float(largest) * max(a.x.shape[1], 1) < 2.0**53  # then floats hold every product and sum
        need, last_id = self._ends()
        i, j = (g.ravel() for g in np.meshgrid(a.roots, c.roots, indexing="ij"))
        pairs = []
        while len(i):
            low, high = np.full(len(i), -np.inf), np.full(len(i), np.inf)
            if exact:
                for s in range(0, len(i), PAIRS):
                    low[s : s + PAIRS], high[s : s + PAIRS] = intervals(a, c, i[s : s + PAIRS], j[s : s + PAIRS])
            on = self._fits(c, i, j) & self._of_use(c, i, j, low, high, need, last_id)
            i, j, low, high = i[on], j[on], low[on], high[on]
            split_a, split_c = a.left[i] >= 0, c.left[j] >= 0
            done = ~split_a & ~split_c
            pairs.append((i[done], j[done], low[done], high[done]))
            i, j, split_a, split_c = i[~done], j[~done], split_a[~done], split_c[~done]
            # the children of whichever has some
            kids_a = np.where(split_a[:, None], a.left[i][:, None] + [0, 1], np.stack([i, np.full(len(i), -1)], 1))
            kids_c = np.where(split_c[:, None], c.left[j][:, None] + [0, 1], np.stack([j, np.full(len(j), -1)], 1))
            i, j = np.repeat(kids_a, 2, axis=1).ravel(), np.tile(kids_c, 2).ravel()
            real = (i >= 0) & (j >= 0)
            i, j = i[real], j[real]
        i, j, low, high = (np.concatenate(p) for p in zip(*pairs, strict=True))
        need = self.need()
        for p in np.argsort(-high, kind="stable").tolist():
            self._score(c, int(i[p]), int(j[p]), high[p], need, exact)
            if self.gathered > FOUND:
                self._rank()
                need = self.need()
        self._rank()

    def _score(self, c: Forest, i: int, j: int, high: float, need: np.ndarray, exact: bool) -> None:
        """Scores of all rows of two leaves."""
        a = self.anchors
        q0, q1 = self.starts[a.first[i]], self.starts[a.end[i]]
        wants = need[q0:q1]
        if q0 == q1 or high < wants.min():
            return
        self.leaf_pairs += 1
        rows, cols = slice(a.first[i], a.end[i]), slice(c.first[j], c.end[j])
        if exact:
            s = (a.x[rows].astype(np.float64) @ c.x[cols].T.astype(np.float64)).astype(np.int64)
        else:
            s = np.clip(a.x[rows].astype(object) @ c.x[cols].T.astype(object), _LEAST + 1, _MOST).astype(np.int64)
        of = self.row[q0:q1]
        s = s[of - a.first[i]]
        fits = (a.labels[of][:, None] == c.labels[cols]) == self.same
        fits &= (s >= wants[:, None]) & (s <= self.most[q0:q1, None]) & (a.ids[of][:, None] != c.ids[cols])
        # a leaf can't give a query more than its own best k and their ties
        if self.k < fits.shape[1] and fits.any():
            best = np.partition(np.where(fits, s, _LEAST), fits.shape[1] - self.k, axis=1)[:, fits.shape[1] - self.k]
            fits &= s >= best[:, None]
        q, v = np.nonzero(fits)
        if len(q):
            self.waiting.append((q + q0, s[q, v], c.ids[cols][v]))
            self.gathered += len(q)


# ---- jobs


def _searched(wave, k: int, same_label: bool):
    def run(batches):
        blocks, row, keys, least, most = wave.value
        search = Search(Forest(blocks), row, least, most, k, same_label)
        for b in batches:
            for r in b.to_pylist():
                search.visit(Forest([_unpacked(r["n"], r["ids"], r["labels"], r["x"])]))
        q, rank = np.nonzero(search.scores != _LEAST)
        yield pa.record_batch([pa.array(row[q]), pa.array(keys[q]), pa.array(search.scores[q, rank]), pa.array(search.found[q, rank])], ["anchor", "key", "score", "vec_id"])

    return run


def _best(candidates: DataFrame, wave, k: int, same_label: bool, name: str) -> DataFrame:
    """anchor (its place in the wave), key, rank, score, vec_id: the k best of each search of a wave."""
    found = candidates.mapInArrow(lean(_searched(wave, k, same_label)), "anchor long, key long, score long, vec_id long")
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id")
    return staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, label, vector: an
    array of whole numbers).

    A row's score is its inner product with the anchor. Higher scores come first, ties by smaller vec_id. Positives are
    an anchor's first rows of its label and another vec_id; negatives are the first rows of other labels whose score is
    from `low` to `high` per cent of the positive's (none, if that is negative). Rows with a null id, label, vector or
    component take no part. A shorter vector counts as filled up with zeros; empty vectors score 0. Repeated rows count as
    often as they occur, as anchors and as candidates. Scores beyond a long are cut to its range. Other columns are
    ignored; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = staged(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL)"), "vectors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, n_anchors, dims, least_dims = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("x")), F.min(F.size("x"))).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    if dims != least_dims:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    depth = max(0, min(n // BLOCK, MOST_LEAVES).bit_length() - 1) if dims else 0
    sample = rows.select("x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("x") if depth else None
    levels = _coarse(_matrix(sample).astype(np.float64), depth) if depth else []

    def leaves(batches):
        for b in batches:
            at = _leaf_of(_matrix(b.column(2)).astype(np.float64), levels) if b.num_rows and levels else np.zeros(b.num_rows, np.int64)
            yield pa.record_batch([*b.columns, pa.array(at)], [*b.schema.names, "leaf"])

    leafed = staged(rows.mapInArrow(lean(leaves), "vec_id long, label long, x array<long>, is_anchor boolean, leaf long"), "leaves")
    candidates = staged(_blocks(leafed, levels, BLOCK), "candidates")
    n_waves = -(-n_anchors // WAVE)
    anchors = _blocks(leafed.where("is_anchor"), levels, max(LEAF, WAVE // 16))
    anchors = staged(anchors.withColumn("wave", F.pmod(F.xxhash64("ids"), F.lit(n_waves))), "anchors")
    out = []
    for w in range(n_waves):  # each is bounded by WAVE, about
        blocks = [_unpacked(r["n"], r["ids"], r["labels"], r["x"]) for r in anchors.where(F.col("wave") == w).select("n", "ids", "labels", "x").collect()]
        if not blocks:
            continue
        ids = np.concatenate([b[0] for b in blocks])
        row = np.arange(len(ids))
        first = spark.sparkContext.broadcast((blocks, row, 0 * row, np.full(len(ids), _LEAST), np.full(len(ids), _MOST)))
        near = _best(candidates, first, positives, True, "positives")
        # an anchor's different positive scores, each a search of its own
        share = lambda c, percent: F.expr(f"CAST({percent} * CAST({c} AS DECIMAL(38, 0)) AS DECIMAL(38, 0))")
        bands = near.select("anchor", F.col("score").alias("p")).where("p >= 0").distinct()
        bands = bands.withColumns({"least": F.ceil(share("p", low) / 100).cast("long"), "most": F.floor(share("p", high) / 100).cast("long")}).where("least <= most").orderBy("anchor", "p")
        asked = bands.select("anchor", "p", "least", "most").toArrow()  # positives * WAVE rows at most
        second = spark.sparkContext.broadcast((blocks, *(asked.column(c).to_numpy().astype(np.int64) for c in asked.column_names)))
        far = _best(candidates, second, negatives, False, "negatives")
        first.destroy()
        second.destroy()
        names = spark.createDataFrame(pa.table({"anchor": pa.array(row), "anchor_id": pa.array(ids)}))
        pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = far.select("anchor", F.col("key").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out.append(staged(pairs.join(found, ["anchor", "positive_score"]).join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "mined"))
        discard(near, far)
    discard(candidates, anchors)
    return reduce(DataFrame.unionByName, out)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    vectors = rows.select("vec_id", label.alias("label"), F.expr("transform(embedding, x -> floor(256 * double(x)))").alias("vector"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)

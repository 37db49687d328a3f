"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeated windows merge into
maximal removal intervals.

1. Every window has an anchor, the least hash of the ANCHOR-word grams in it. Equal windows have equal anchors, and
   neighbouring windows share theirs, so counting anchors moves about an eighth of the hashes. A Bloom filter of bounded
   size holds the anchors that occur twice.
2. Only windows with such an anchor move, as (hash, check, doc_id, place), once per batch and hash (a map-side combine:
   a very common window moves once per batch at most). Sorted by hash, check, doc_id and place, all but the first are
   repeats. hash and check are polynomials at two random bases, 93 bits together: two different windows are taken for
   equal with a probability of 20 * 2**-61 * 2**-32 a pair.
3. Repeats sorted by document merge into intervals, which meet the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm import _hashing as H
from recollex.llm._shared import keyed, lean, same_row, small, staged

WINDOW, ANCHOR = 20, 6
#: Bits of the anchor filter at most (32 MB). A fuller filter lets more windows move; the result stays exact.
MAX_FILTER_BITS, MIN_FILTER_BITS, BITS_PER_ANCHOR = 1 << 28, 1 << 16, 16
#: Hashes that a task puts into a filter, about.
KEYS_A_TASK = 2_000_000
#: The random base of the windows' check.
CHECK_BASE = 0x0B7E151628AED2A6


def _anchors(words: np.ndarray, offs: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: document, place, its place among all words, window hash and anchor."""
    doc, place = H.starts_in_documents(offs, window)
    at = offs[:-1][doc] + place
    if not len(at):
        e = np.zeros(0, np.uint64)
        return doc, place, at, e, e
    least = H.sliding_min(H.gram_hashes(words, anchor), window - anchor + 1)
    return doc, place, at, H.gram_hashes(words, window)[at], least[at]


def _checks(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """32 more bits of the windows that begin at some places."""
    return (H.gram_hashes(words, window, CHECK_BASE)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _text_chunks(batches, *columns):
    """(arrays of the columns, words, word offsets) of each chunk of documents."""
    for b in batches:
        data, offs = H.text_buffers(b.column(b.schema.get_field_index("text")))
        for lo, hi in H.chunks_of(offs, 4 * H.CHUNK):
            words, w = [], [np.zeros(1, np.int64)]
            for a, z in H.chunks_of(offs[lo : hi + 1]):
                h, o = H.hashed_words(data[offs[lo + a] : offs[lo + z]], offs[lo + a : lo + z + 1] - offs[lo + a], False)
                words.append(h)
                w.append(o[1:] + w[-1][-1])
            yield [b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in columns], np.concatenate(words), np.concatenate(w)


def _count_anchors(window: int, anchor: int):
    def run(batches):
        for _, words, offs in _text_chunks(batches):
            doc, _, _, h, least = _anchors(words, offs, window, anchor)
            if len(h):
                # a run of equal anchors within a document counts once, unless its windows repeat one another
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                run_of = np.cumsum(new) - 1
                inner = np.sort(run_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h)
                values, n = np.unique(least[new], return_counts=True)
                if (inner[1:] == inner[:-1]).any():
                    _, first, per = np.unique(np.stack([run_of.astype(np.uint64), h], 1), axis=0, return_index=True, return_counts=True)
                    n[np.isin(values, least[first[per > 1]])] += 1
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return H.mix(h) & m, H.mix(h ^ np.uint64(0x5851F42D4C957F2D)) & m


def _in_filter(h: np.ndarray, filt: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in _slots(h, bits):
        out &= (filt[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _filter_blocks(bits: int):
    """Hashes of a partition to blocks of 4 KB of the filter: (block, bits)."""

    def run(batches):
        out = np.zeros(max(bits // 8, 4096), np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in _slots(h, bits):
                np.bitwise_or.at(out, (s >> np.uint64(3)).astype(np.int64), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
        blocks = out.reshape(-1, 4096)
        for k in np.flatnonzero(blocks.any(1)):
            yield pa.record_batch([pa.array([int(k)], pa.int64()), pa.array([blocks[k].tobytes()], pa.binary())], ["block", "bits"])

    return run


def filter_of(hashes: DataFrame, bits: int, n: int) -> np.ndarray:
    """The Bloom filter of a column of n hashes on the driver: MAX_FILTER_BITS / 8 bytes at most, however large the input.
    Every task builds the blocks of its own rows, which Spark merges; tasks are as many as n needs, since each may send
    all blocks."""
    blocks = hashes.coalesce(1 + n // KEYS_A_TASK).mapInArrow(lean(_filter_blocks(bits)), "block long, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * 4096 : r["block"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _moving_windows(window: int, anchor: int, filt, bits: int):
    """Windows with a repeated anchor, the first of each hash in the chunk (kind 0: hash, doc_id, row_key, place), and
    what the chunk itself shows to be repeated (kind 1: intervals as place and stop)."""

    def run(batches):
        table = filt.value
        for (ids, keys), words, offs in _text_chunks(batches, "doc_id", "row_key"):
            doc, place, at, h, least = _anchors(words, offs, window, anchor)
            move = np.flatnonzero(_in_filter(least, table, bits)) if len(h) else np.zeros(0, np.int64)
            if not len(move):
                continue
            doc, place, h, check = doc[move], place[move], h[move], _checks(words, at[move], window)
            id_of, key_of = _ids(ids), keys.to_numpy(zero_copy_only=False)
            order = np.lexsort((place, key_of[doc], id_of[doc], check, h))
            doc, place, h, check = doc[order], place[order], h[order], check[order]
            later = np.zeros(len(h), bool)
            later[1:] = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
            # rows that repeat a whole (doc_id, text) are one document: the same place in it is not an earlier one
            first = np.maximum.accumulate(np.where(later, 0, np.arange(len(h))))
            same = later & (id_of[doc] == id_of[doc[first]]) & (key_of[doc] == key_of[doc[first]]) & (place == place[first])
            out = ~later
            yield _rows(0, h[out], check[out], id_of[doc[out]], key_of[doc[out]], place[out], place[out])
            gone = later & ~same
            d, p = doc[gone], place[gone]
            order = np.lexsort((p, d))
            d, p = d[order], p[order]
            if len(d):
                a, z = _runs(d, p, window)
                key = H.mix(key_of[d[a]].view(np.uint64) ^ id_of[d[a]].view(np.uint64))
                yield _rows(1, key, np.zeros(len(a), np.int32), id_of[d[a]], key_of[d[a]], p[a], p[z] + window)

    return run


NULL_ID = -(2**63)


def _ids(column) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _runs(d: np.ndarray, p: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of windows of one document that overlap or touch; sorted by document, place."""
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + window)
    a = np.flatnonzero(cut)
    return a, np.append(a[1:], len(d)) - 1


def _rows(kind: int, h, check, ids, keys, place, stop) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(h), kind, np.int8)), pa.array(h.view(np.int64)), pa.array(check), pa.array(ids.astype(np.int64)), pa.array(keys.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(stop.astype(np.int32))], ["kind", "h", "check", "doc_id", "row_key", "place", "stop"])


def _later_windows(window: int):
    """Rows sorted by hash, check, kind, doc_id, row_key and place: the later ones of each hash and check, and the
    intervals as they are."""

    def run(batches):
        last = None
        for b in batches:
            kind, h, check, ids, keys, place, stop = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            own = np.flatnonzero(kind == 0)
            hh, cc, ii, kk, pp = h[own], check[own], ids[own], keys[own], place[own]
            keep = np.zeros(len(h), bool)
            if len(own):
                new = np.ones(len(own), bool)
                new[1:] = (hh[1:] != hh[:-1]) | (cc[1:] != cc[:-1])
                if last is not None and last[:2] == (hh[0], cc[0]):
                    new[0] = False
                at = np.maximum.accumulate(np.where(new, np.arange(len(own)), -1))
                fi, fk, fp = (np.where(at >= 0, x[np.maximum(at, 0)], y) for x, y in zip((ii, kk, pp), last[2:] if last else (0, 0, 0), strict=True))
                keep[own] = ~new & ~((ii == fi) & (kk == fk) & (pp == fp))
                last = (hh[-1], cc[-1], fi[-1], fk[-1], fp[-1])
            stop = np.where(kind == 0, place + window, stop)
            keep |= kind == 1
            if keep.any():
                yield pa.record_batch([pa.array(ids[keep]), pa.array(keys[keep]), pa.array(place[keep]), pa.array(stop[keep].astype(np.int32))], ["doc_id", "row_key", "place", "stop"])

    return run


def _merged(batches):
    """Intervals sorted by document and place, merged where they overlap or touch."""
    held = None
    for b in batches:
        ids, keys, a, z = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        out = []
        if held is not None:
            ids, keys, a, z = (np.concatenate([[x], y]) for x, y in zip(held, (ids, keys, a, z), strict=True))
        if not len(ids):
            continue
        new_doc = np.ones(len(ids), bool)
        new_doc[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        # running maximum of the stops within a document: lift each document above all before it
        lift = (np.cumsum(new_doc) - 1) * (int(z.max()) + 2)
        top = np.maximum.accumulate(z.astype(np.int64) + lift)
        cut = new_doc.copy()
        cut[1:] |= a[1:].astype(np.int64) + lift[1:] > top[:-1]
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(ids)) - 1
        out = [ids[s], keys[s], a[s].astype(np.int32), (top[e] - lift[e]).astype(np.int32)]
        held = tuple(x[-1] for x in out)
        if len(s) > 1:
            yield pa.record_batch([pa.array(x[:-1]) for x in out], ["doc_id", "row_key", "place", "stop"])
    if held is not None:
        yield pa.record_batch([pa.array(np.array([x], t)) for x, t in zip(held, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["doc_id", "row_key", "place", "stop"])


INTERVAL = "doc_id long, row_key long, place int, stop int"


def removal_intervals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Maximal word intervals [place, stop) of keyed documents whose windows also start earlier (in a smaller doc_id, or
    in the same document before). A null doc_id counts as smallest and is given as NULL_ID."""
    texts = docs.select("text")
    counted = texts.mapInArrow(lean(_count_anchors(window, anchor)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    again = staged(counted, "anchors")
    n = again.count()
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (max(n, 1) * BITS_PER_ANCHOR - 1).bit_length()))
    spark = docs.sparkSession
    filt = spark.sparkContext.broadcast(filter_of(again, bits, n))
    moving = docs.mapInArrow(lean(_moving_windows(window, anchor, filt, bits)), "kind byte, h long, check int, " + INTERVAL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    later = moving.repartition(parts, "h").sortWithinPartitions("h", "check", "kind", "doc_id", "row_key", "place").mapInArrow(lean(_later_windows(window)), INTERVAL)
    return later.repartition(parts, "doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "place").mapInArrow(lean(_merged), INTERVAL)


def _cut(batches):
    for b in batches:
        ids, texts, gaps = b.column(0), b.column(1), b.column(2)
        data, offs = H.text_buffers(texts)
        raw = data.tobytes()
        rows = []
        for i, cuts in enumerate(gaps.to_pylist()):
            words = raw[offs[i] : offs[i + 1]].split()
            n, gone = len(words), 0
            if cuts:
                kept, at = [], 0
                for a, z in sorted((c["place"], c["stop"]) for c in cuts):
                    kept += words[at:a]
                    gone += z - a
                    at = z
                words = kept + words[at:]
            rows.append((n, gone, b" ".join(words)))
        yield pa.record_batch([ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _digest(batches):
    for out in _cut(batches):
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in out.column(3)]
        yield pa.record_batch([*out.columns[:3], pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_gaps(docs: DataFrame, window: int) -> DataFrame:
    docs = keyed(docs)
    found = removal_intervals(docs, window)
    gaps = found.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("place", "stop")).alias("gaps"))
    gaps = staged(gaps.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))), "gaps")
    rows = gaps.agg(F.sum(F.size("gaps") + 3)).head()[0] or 0
    gaps = small(gaps, rows)
    return docs.join(gaps, same_row(docs, gaps), "left").select(docs["doc_id"], docs["text"], gaps["gaps"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs: the words that no repeated window covers, joined by
    one space. A window of `window` words is repeated if the same words also start earlier (smaller doc_id, or same
    document, earlier start). Null, empty and short texts keep all; rows that repeat doc_id and text are judged as one
    document; extra columns are ignored; an empty table gives none."""
    return _with_gaps(docs, window).mapInArrow(lean(_cut), "doc_id long, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _with_gaps(docs, WINDOW).mapInArrow(lean(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS h FROM p),
f AS (SELECT *, CASE WHEN h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN s USING (doc_id)
"""

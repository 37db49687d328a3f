"""BPE encoding and decoding with a public vocabulary whose pieces mark word ends.

A word's bytes are the first symbols, in a doubly linked list. A priority queue holds the merges that neighbours allow,
by rank and place; the least is taken, skipped if one of its symbols has changed since it was pushed, else its two
symbols become one, and the pairs with the new neighbours are pushed. What is left is the encoding. Decoding joins the
vocabulary's strings of the ids.

Texts fall into units (words, or parts of words) that the rules handle apart. Within a block the distinct units are
encoded once, and their ids are remembered by hashes while there is room. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollex.llm import _hashing as H
from recollex.llm._shared import lean, text_or_empty
from recollex.llm.packing import BLOCK_BYTES, _default_path, _Encoder


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    are numbered from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    number = {b: 256 + k for k, b in enumerate(others)}
    return [chr(number.get(b, b)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: merges with word ends and special tokens are kept here; how texts are normalised and
    split into words is left to the file's own normalizer and pre-tokenizer, whose Unicode tables then decide."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix or rules["decoder"] is not None or rules["pre_tokenizer"]["pretokenizers"][-1]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left, right): (rank, id of both as one)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = t
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        whole = Tokenizer.from_file(path)
        self.normalized, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.byte = {c: b for b, c in enumerate(letters)}

    def word(self, raw: bytes) -> list[int]:
        """Ids of the bytes of one word, at the end of which the suffix stands."""
        ids = [self.first[b] for b in raw[:-1]] + [self.last[b] for b in raw[-1:]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        merges = self.merges
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m is not None:
                queue.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, whole, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((whole, ids[k]))
                if m is not None:
                    heapq.heappush(queue, (m[0], i, m[1], whole, ids[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], whole))
                if m is not None:
                    heapq.heappush(queue, (m[0], h, m[1], ids[h], whole))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        out = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for word, _ in self.split(self.normalized(part)):
                out += self.word(bytes(map(self.byte.__getitem__, word)))
        return out

    def decode(self, ids) -> str:
        """The strings of the ids, with one space between, as the vocabulary has no decoder of its own."""
        return " ".join(map(self.strings.__getitem__, ids))


class _Units(_Encoder):
    """Ids of many texts: packing's units, encoded by the merges above."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def _joined(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def _regular(self, low, starts, ends):
        return self._joined([self.vocabulary.word(low[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    def _irregular(self, words):
        return self._joined([self.vocabulary.encode(w.decode()) for w in words])


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(path: str):
    def run(batches):
        encode = _Units(vocabulary(path))
        for b in batches:
            data, offs = H.text_buffers(b.column(1))
            for lo, hi in H.chunks_of(offs, BLOCK_BYTES):
                ids, at = encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, without special tokens added.

    Null and empty texts have no ids; special tokens that a text spells out become their ids; a null doc_id stays null; a
    very long text is encoded alone; repeated rows get equal ids; other columns are ignored; an empty table gives none.
    Of merges with one rank the leftmost comes first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(lean(_encoded(tokenizer_path or _default_path())), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches):
        strings = [s.encode() for s in vocabulary(path).strings]
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            for lo, hi in H.chunks_of(at, BLOCK_BYTES):
                ids = lists.values[at[lo] : at[hi]].to_numpy(zero_copy_only=False).tolist()
                texts = [b" ".join(map(strings.__getitem__, ids[x:y])) for x, y in zip((at[lo:hi] - at[lo]).tolist(), (at[lo + 1 : hi + 1] - at[lo]).tolist(), strict=True)]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), lists.slice(lo, hi - lo), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return run


def decode_documents(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the vocabulary's strings of the ids. No ids, or null, give an empty text; an
    id that the vocabulary lacks is an error; repeated rows get equal texts; other columns are ignored."""
    rows = encoded.select("doc_id", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lean(_decoded(tokenizer_path or _default_path())), "doc_id long, ids array<int>, decoded string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    out = decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""All literal phrases of a rule list in one pass: an Aho-Corasick automaton run over many pieces of text at once.

Texts of a batch are laid one after the other and cut into lanes of equal length; every step moves the states of all lanes
by one character, an indexed read of the transition table. A lane starts as many characters before its own part as the
longest phrase has, so it has the right state where its part begins, and a border between texts leads back to the root.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are scanned at a time, which bounds a task's memory; and lanes, at most, that they are cut into.
SLAB = 1 << 21
LANES = 1 << 11


class Automaton:
    """Transitions of the phrases' trie with failure arcs filled in: one row of next states for each state, one column for
    each letter of the phrases, one (0) for other letters and borders."""

    def __init__(self, phrases: list[tuple[int, str]]):
        self.always = sorted(i for i, p in phrases if not p)  # the empty phrase is in every text
        phrases = [(i, p) for i, p in phrases if p]
        letters = sorted({ord(c) for _, p in phrases for c in p})
        self.width, self.longest = len(letters) + 1, max((len(p) for _, p in phrases), default=1)
        self.column = np.zeros(0x110000, np.uint16 if self.width < 65536 else np.uint32)
        self.column[letters] = np.arange(1, self.width)
        arcs: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, p in phrases:
            at = 0
            for c in p:
                k = int(self.column[ord(c)])
                if k not in arcs[at]:
                    arcs[at][k] = len(arcs)
                    arcs.append({})
                    ends.append([])
                at = arcs[at][k]
            ends[at].append(i)
        self.next = np.zeros((len(arcs), self.width), np.int32)
        fail = [0] * len(arcs)
        self.next[0, list(arcs[0])] = list(arcs[0].values())
        queue = deque(arcs[0].values())
        while queue:
            at = queue.popleft()
            ends[at] = ends[at] + ends[fail[at]]  # phrases that end a longer one
            self.next[at] = self.next[fail[at]]
            for k, to in arcs[at].items():
                fail[to] = int(self.next[at, k])
                self.next[at, k] = to
                queue.append(to)
        self.ends = [sorted(set(e)) for e in ends]
        self.hit = np.array([bool(e) for e in ends])

    def find(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the phrases that each text holds, ascending."""
        out: list[set[int]] = [set(self.always) for _ in texts]
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            group.append(k)
            size += len(t) + 1
            if size >= SLAB or k == len(texts) - 1:
                self._scan(texts, group, out)
                group, size = [], 0
        return [sorted(s) for s in out]

    def _scan(self, texts: list[str], group: list[int], out: list[set[int]]) -> None:
        bounds = np.cumsum([0] + [len(texts[k]) + 1 for k in group])
        letters = np.zeros(bounds[-1], self.column.dtype)
        for k, a in zip(group, bounds, strict=False):
            codes = np.frombuffer(texts[k].encode("utf-32-le"), np.uint32)
            letters[a : a + len(codes)] = self.column[codes]
        for a in range(0, len(letters), SLAB):  # a text of any length goes through in parts that overlap
            first = max(0, a - self.longest)
            self._lanes(letters[first : a + SLAB], a - first, first, bounds, group, out)

    def _lanes(self, letters, skip: int, offset: int, bounds, group, out) -> None:
        """Adds the hits that end at a place from skip on."""
        lead = self.longest
        part = max((len(letters) + LANES - 1) // LANES, 4 * lead)
        lanes = (len(letters) + part - 1) // part
        padded = np.zeros(lead + lanes * part, letters.dtype)
        padded[lead : lead + len(letters)] = letters
        columns = np.lib.stride_tricks.as_strided(padded, (lead + part, lanes), (padded.strides[0], part * padded.strides[0]))
        state = np.zeros(lanes, np.int64)
        table, width = self.next.ravel(), self.width
        places, states = [], []
        for step in range(lead + part):
            state = table[state * width + columns[step]]
            if step >= lead:
                found = np.flatnonzero(self.hit[state])
                if len(found):
                    places.append(found * part + (step - lead))
                    states.append(state[found])
        if not places:
            return
        place, state = np.concatenate(places), np.concatenate(states).astype(np.int64)
        own = place >= skip
        where = np.searchsorted(bounds, place[own] + offset, side="right") - 1
        for key in np.unique(where * len(self.ends) + state[own]).tolist():  # each state once a text
            out[group[key // len(self.ends)]].update(self.ends[key % len(self.ends)])


def _parts(b: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch with about SLAB bytes of text (one text at least), so that a worker turns no more into strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(b):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLAB, side="right")))
        yield b.slice(a, z - a)
        a = z
    if not len(b):
        yield b


def held_phrases(c: Column, phrases: list[tuple[int, str]]) -> Column:
    """Array of the numbers of the phrases (number, text; case matters) that a text holds, ascending; of a null text none.
    The list goes to every task, so it is one that a rule file holds, not a table's column."""

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(phrases)
        for b in batches:
            yield pa.concat_arrays([pa.array(automaton.find(["" if t is None else t for t in part.to_pylist()]), pa.list_(pa.int32())) for part in _parts(b)])
            pa.default_memory_pool().release_unused()

    return F.when(c.isNotNull(), find(c)).otherwise(F.array().cast("array<int>"))

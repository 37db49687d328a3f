"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon has a short fixed list and the words and word beginnings (stems) that labelled texts show to be toxic. A
word of a text is matched by running its bit-parallel Levenshtein automaton down the trie, so one walk compares it with
every term. The words around a hit say whether it is quoted or aimed at someone. A logistic regression over the counts
gives the score. Where the labelled texts have no quoted hit, quoted hits get a fixed discount.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm._shared import give_back, lean, learned_crc, staged, text_or_empty

#: Labelled documents that are learned from at most: those with the least hashes of their doc_id.
TRAIN_DOCS = 16_000
#: A mined term is in at least LEAST_SHARE of the toxic documents (and in LEAST_DOCS) and ODDS times as frequent there.
LEAST_SHARE, LEAST_DOCS, ODDS = 0.012, 3, 25.0
#: A term's neighbours vary: words of one passage that many documents share are no terms.
VARIED = 0.6
STEMS = range(3, 9)
#: Tasks that mine terms: few, so that a shared passage is seen as such.
MINERS = 2
#: Terms of fewer letters are matched exactly, others with one error.
FUZZY = 5
WINDOW = 6
#: Words known not to match that a Python worker remembers within a partition.
REMEMBERED = 200_000

#: General insults, words of reported speech, and words that address someone.
INSULTS = "idiot idiots moron stupid loser pathetic worthless disgusting trash scum clown dumb fool jerk imbecile bastard freak filthy vermin".split()
REPORTING = set("said says wrote writes quote quoted quotes called word words term phrase means meaning sagte schrieb zitat wort nannte dit écrit citation mot appelé dijo escribió cita palabra llamó".split())
ADDRESS = set("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton vous votre tú ti tus usted ustedes eres are".split())
QUOTES = set("\"“”„«»‘’")

_WORD = re.compile(r"[\w@$]+")
_LEET = str.maketrans("013457@$", "oieastas")


def plain(word: str) -> str:
    """A word with digits and signs that stand for letters replaced, if it has letters too."""
    return word.translate(_LEET) if not word.isalpha() and any(c.isalpha() for c in word) else word


class Lexicon:
    """A trie of terms: (text, is_stem). A stem matches words that begin with it and go on; others match whole words."""

    def __init__(self, terms: list[tuple[str, bool]], clean_variants: frozenset[str] = frozenset()):
        self.terms, self.clean = sorted(terms), clean_variants
        self.root: dict = {}
        self.first: set[str] = set()
        self.second: set[str] = set()
        for text, stem in self.terms:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((text, stem))
            self.first.add(text[:3])
            if len(text) >= FUZZY:
                self.second.add(text[3:5])
        self._none: set[str] = set()
        self._known: dict[str, tuple[str, int, str]] = {}

    def __getstate__(self):
        return self.terms, self.clean

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self._none.clear()
        self._known.clear()

    def _may_match(self, w: str) -> bool:
        """One error leaves the first three letters or those after them intact, shifted by one place at most."""
        s = self.second
        return w[:3] in self.first or w[2:4] in s or w[3:5] in s or w[4:6] in s

    def match(self, word: str) -> tuple[str, int, str] | None:
        """(term, errors, what of the word matched) with the fewest errors, then the longest term; None if nothing does."""
        if word in self._none:
            return None
        found = self._known.get(word)
        if found is None:
            w = plain(word)
            found = self._walk(w) if self._may_match(w) else None
            if found is None:
                if len(self._none) < REMEMBERED:
                    self._none.add(word)
            elif len(self._known) < REMEMBERED:
                self._known[word] = found
        return found

    def _walk(self, w: str) -> tuple[str, int, str] | None:
        n = len(w)
        at: dict[str, int] = {}
        for i, c in enumerate(w):
            at[c] = at.get(c, 0) | 1 << i
        full, best = (1 << n + 1) - 1, None
        todo = [(self.root, 1, 3)]  # bit i: the path so far is the word's first i letters, with no or one error
        while todo:
            node, zero, one = todo.pop()
            for text, stem in node.get("", ()):
                for errors, bits in ((0, zero), (1, one)):
                    if errors and len(text) < FUZZY:
                        break
                    bits &= full
                    end = None
                    if not stem:
                        end = n if bits >> n & 1 else None
                    else:
                        bits &= (1 << n) - 1  # a stem goes on
                        if bits:
                            end = len(text) if bits >> len(text) & 1 else bits.bit_length() - 1
                    if end is not None:
                        rank = (errors, -len(text), text)
                        if (best is None or rank < best[0]) and not (errors and w[:end] in self.clean):
                            best = (rank, w[:end])
                        break
            for c, child in node.items():
                if c:
                    b = at.get(c, 0)
                    z = (zero & b) << 1
                    o = ((one & b) << 1 | zero | zero << 1 | z << 1) & full
                    if z | o:
                        todo.append((child, z, o))
        return None if best is None else (best[0][2], best[0][0], best[1])


FEATURES = 6
EXACT, QUOTED, TERMS = 0, 3, 4


def features(lexicon: Lexicon, text: str) -> tuple[np.ndarray, int]:
    """Counts for the regression and the number of hits: exact and misspelled hits, those of them that address someone,
    those that are quoted, distinct terms, and hits per word."""
    low = text.lower()
    hits = {w for w in set(_WORD.findall(low)) - lexicon._none if lexicon.match(w)}
    out = np.zeros(FEATURES)
    if not hits:
        return out, 0
    spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
    words = [s[0] for s in spans]
    exact = fuzzy = aimed = quoted = 0
    terms = set()
    for k, w in enumerate(words):
        if w not in hits:
            continue
        term, errors, _ = lexicon.match(w)
        terms.add(term)
        fuzzy += errors
        exact += not errors
        around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        left, right = spans[max(0, k - WINDOW)][1], spans[min(len(spans) - 1, k + WINDOW)][2]
        open_ = QUOTES & set(low[left : spans[k][1]])
        close = QUOTES & set(low[spans[k][2] : right])
        if (open_ and close) or REPORTING & set(around):
            quoted += 1
        elif ADDRESS & set(around):
            aimed += 1
    n = exact + fuzzy
    return np.array([np.log1p(exact), np.log1p(fuzzy), np.log1p(aimed), np.log1p(quoted), np.log1p(len(terms)), min(1.0, 20 * n / len(words))]), n


def _term_candidates(word: str) -> list[tuple[str, bool]]:
    w = plain(word)
    return [(w, False), *((w[:k], True) for k in STEMS if k < len(w))]


def _count_terms(wanted):
    """(term, stem, n, contexts) of a partition: in how many documents a term is, and hashes of the different pairs of
    neighbours that it is between. With wanted, of these terms only, and without contexts."""

    def run(batches):
        only = None if wanted is None else wanted.value
        counts: Counter = Counter()
        contexts: dict[tuple[str, bool], set[int]] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                if only is not None:
                    counts.update({t for w in set(words) for t in _term_candidates(w)} & only)
                    continue
                seen = set()
                for left, w, right in zip([""] + words, words, words[1:] + [""], strict=False):
                    place = int.from_bytes(hashlib.blake2b(f"{left} {right}".encode(), digest_size=8).digest(), "little", signed=True)
                    for t in _term_candidates(w):
                        seen.add(t)
                        contexts.setdefault(t, set()).add(place)
                counts.update(seen)
        if counts:
            keys = list(counts)
            yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([counts[k] for k in keys], pa.int64()), pa.array([sorted(contexts.get(k, ())) for k in keys], pa.list_(pa.int64()))], ["term", "stem", "n", "contexts"])

    return run


def _clean_matches(lexicon):
    """What of clean texts' words the lexicon matches with an error."""

    def run(batches):
        lex, out = lexicon.value, set()
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in set(_WORD.findall((text or "").lower())):
                    m = lex.match(w)
                    if m and m[1]:
                        out.add(m[2])
        lex.forget()
        yield pa.record_batch([pa.array(sorted(out), pa.string())], ["variant"])

    return run


def _features_of(lexicon):
    def run(batches):
        lex = lexicon.value
        for b in batches:
            x = [features(lex, t or "")[0].tolist() for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["toxic", "copies", "x"])
        lex.forget()

    return run


def choose_terms(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """Terms to keep of (term, stem, toxic documents, clean documents): frequent and telling; the shortest stem of what
    they cover, unless a longer one is in as many documents."""
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    good = {}
    for term, stem, tox, clean in rows:
        if tox >= least and tox / max(n_toxic, 1) >= ODDS * (clean + 0.5) / (n_clean + 1):
            good[term, stem] = tox
    out: list[tuple[str, bool]] = []
    for (term, stem), tox in sorted(good.items(), key=lambda x: (len(x[0][0]), x[0])):
        if stem and any(good.get((term + c, s), 0) >= 0.98 * tox for c in _next_letters(term, good) for s in (True, False)):
            continue  # nearly the same documents have a longer form
        if any(s and term.startswith(t) and len(term) > len(t) for t, s in out):
            continue
        out.append((term, stem))
    return out


def _next_letters(term: str, good) -> set[str]:
    return {t[len(term)] for t, _ in good if len(t) == len(term) + 1 and t.startswith(term)}


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method with a ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.diag([ridge * len(x) / 100 + ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + keep
        step = np.linalg.solve(h, z.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


Model = tuple[Lexicon, np.ndarray]


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """A model from the documents of labels (doc_id, toxic), limit of them at most: a bounded sample, of which counts of
    terms and, of each text, FEATURES numbers reach the driver. Null labels don't count; of several labels of a
    document the largest does. Without toxic labels the fixed list alone is scored by fixed weights."""
    spark = docs.sparkSession
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id"), text_or_empty(docs).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    parts = max(spark.sparkContext.defaultParallelism, 8)
    # copies of a text are one document for the terms; the regression has each of them
    sample = staged(texts.groupBy("text", "toxic").agg(F.count("*").alias("copies")).repartition(parts), "sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    fixed = [(w, False) for w in INSULTS]
    if not n_toxic or not n_clean:
        return Lexicon(fixed), np.array([2.0, 1.0, 1.0, -1.0, 1.0, 0.5, -3.0])
    cols = "term string, stem boolean, n long, contexts array<long>"
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    counted = sample.where("toxic = 1").coalesce(MINERS).mapInArrow(lean(_count_terms(None)), cols).groupBy("term", "stem").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    often = counted.where((F.col("n") >= least) & (F.col("contexts") >= VARIED * F.col("n")))
    tox = {(r["term"], r["stem"]): r["n"] for r in often.toLocalIterator()}
    wanted = spark.sparkContext.broadcast(frozenset(tox))
    seen = sample.where("toxic = 0").mapInArrow(lean(_count_terms(wanted)), cols).groupBy("term", "stem").agg(F.sum("n").alias("n"))
    clean = {(r["term"], r["stem"]): r["n"] for r in seen.toLocalIterator()}
    mined = choose_terms([(*t, n, clean.get(t, 0)) for t, n in tox.items()], n_toxic, n_clean)
    words = [t for t in fixed if clean.get(t, 0) * n_toxic <= tox.get(t, 0) * n_clean or t not in tox]
    terms = sorted({*words, *mined})
    rough = spark.sparkContext.broadcast(Lexicon(terms))
    variants = sample.where("toxic = 0").mapInArrow(lean(_clean_matches(rough)), "variant string").distinct()
    lexicon = Lexicon(terms, frozenset(r[0] for r in variants.toLocalIterator()))
    shared = spark.sparkContext.broadcast(lexicon)
    table = sample.mapInArrow(lean(_features_of(shared)), "toxic int, copies long, x array<double>").toArrow()
    x, copies = np.array(table.column("x").to_pylist(), float).reshape(-1, FEATURES), table.column("copies").to_numpy()
    return lexicon, discounted(fit_logistic(np.repeat(x, copies, axis=0), np.repeat(table.column("toxic").to_numpy().astype(float), copies)), x)


def discounted(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The weights; if no text that they were learned from quotes a hit, the weight of quoted hits is such that they take
    back what as many exact hits of different terms add."""
    if not x[:, QUOTED].any():
        w = w.copy()
        w[QUOTED] = -(max(w[EXACT], 0) + max(w[TERMS], 0))
    return w


def _score(texts, model: Model) -> np.ndarray:
    lexicon, w = model
    x = np.array([features(lexicon, t or "")[0] for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))


def _scored(shared):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(_score(b.column(2).to_pylist(), shared.value), pa.float64())], ["doc_id", "held_out", "score"])
        shared.value[0].forget()

    return run


def score_toxicity(docs: DataFrame, model: Model, held_out=None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its whole text alone, however long. Null and empty
    texts score like texts without a hit; repeated rows score alike, as do texts with the same counts; extra columns are
    ignored; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(lean(_scored(shared)), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns: null and empty texts stay, repeated rows stay
    or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(_score(t.to_pylist(), shared.value), pa.float64())
        shared.value[0].forget()
        give_back()

    return docs.where(score(text_or_empty(docs)) < threshold)


def training_labels(labels: DataFrame) -> DataFrame:
    """The contract's training rows: crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(learned_crc("doc_id", 3) != 1).select("doc_id", "toxic")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit(docs, training_labels(labels)), learned_crc("doc_id", 3) == 1)

"""Toxicity of documents: a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two words by the subsequences of four letters that both hold, letters in order but not
necessarily side by side. A subsequence that spans s letters (``SPAN`` at most) weighs ``DECAY ** s``, marks for the
two ends of a word count as letters, and the product is divided by the root of each word's summed squared
weights, so 'idxiot' stays near 'idiot'. Characters other than letters are passed over ('i.d.i.o.t'), digits that stand
for letters become these, all letters beyond a to z are one more, and one-letter words in a row make one word.

A sentence is the bag of its words and as toxic as the worst of them. Training sentences have the label of
their document, so most of the toxic ones are harmless. Words that stand in far more sentences of toxic documents than
those of clean ones lead one to expect are their witnesses; near copies of a sentence, by the three words of least hash,
count once. The machine is fitted to witnesses against words of clean sentences, then again after those clean words that
it found worst have joined the latter. Words are described by their kernel values with the landmarks, whitened by the
landmarks' own kernel matrix: witnesses, and words drawn from clean sentences.

As all this is linear in subsequences, the fitted machine is one weight for each of them: workers score words
with a table of these, whatever the number of landmarks. A document's margin is that of its worst word; two
numbers fitted on training documents make it a probability.

Bounds: labels are sampled by hash, ``MOST_DOCUMENTS`` documents of each label at most. All their sentences count, the
driver fits to ``MOST_WITNESSES`` and some ``MOST_WORDS`` words. Every document is scored, in whole.

Nulls: a null or empty text, or one without a letter, has the margin of no word at all, the least there is. Null
labels or ids teach nothing; of repeated ids in the labels the greatest label counts. Without both labels every score is
the share of label 1, or 0. Repeated rows score alike. Sentences over ``SENTENCE`` words are taken in pieces, words over
``WORD`` letters in overlapping ones, the first of which describes the word in training. Empty tables give no rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazelake.llm.common import whole_text, written

DECAY = 0.6
LETTERS = 4
SPAN = 6
WORD = 16
SENTENCE = 60
LANDMARKS = 256
ROUNDS = 2
PENALTY = 1e-4
#: standard deviations by which a word of toxic documents has to exceed what clean ones lead one to expect, and how
#: many times as many there have to be
SURPLUS, TIMES = 5.0, 5
#: weight of all clean words against that of all witnesses, and of one that was taken for a toxic word against another
STRICT, HARD = 10.0, 10.0
MOST_DOCUMENTS = 5_000
MOST_WORDS = 20_000
MOST_WITNESSES = 500
#: words whose margins a task keeps
KEPT = 300_000

# --- fixed values: what stands for a letter, how letters are numbered ---------------------------
STANDS_FOR = str.maketrans("013457@$", "oieastas")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
OTHER, END, SYMBOLS = 27, 28, 29
_CODES = {c: i for i, c in enumerate(ALPHABET, 1)}
NUMBERS = "0123456789"
_PLACES = list(combinations(range(1, SPAN), LETTERS - 1))


# ------------------------------------------------------------------ words
def tokens(text: str) -> list[str]:
    """Words as they stand in the text, in lower case; one-letter words in a row as one, with spaces."""
    words = text.lower().split()
    if sum(len(w) == 1 for w in set(words)) < 3:
        return words
    out, spelled = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha():
            spelled.append(w)
            continue
        out += [" ".join(spelled)] if len(spelled) > 2 else spelled
        spelled = []
        out.append(w)
    return out[:-1]


def codes(word: str) -> list[list[int]]:
    """Letters of a word as numbers between two ends, in pieces; none for a word without letters."""
    if not any(c.isalpha() for c in word):
        return []
    word = word.strip(NUMBERS).translate(STANDS_FOR)
    out = [END, *[_CODES.get(c, OTHER) for c in word if c.isalpha()], END]
    if len(out) <= WORD + 2:
        return [out]
    return [out[at:at + WORD] for at in range(0, len(out) - WORD // 2, WORD // 2)]


def _parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all pieces, the word of each piece)."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        for p in codes(w):
            pieces.append(p)
            owner.append(i)
    out = np.zeros((len(pieces), WORD + 2), dtype=np.int32)
    if pieces:
        sizes = np.array([len(p) for p in pieces])
        out[np.arange(WORD + 2) < sizes[:, None]] = [x for p in pieces for x in p]
    return out, np.array(owner, dtype=np.int64)


def _subsequences(letters: np.ndarray):
    """(numbers of subsequences, 0 where there is none, weight) for each way to leave gaps."""
    n = letters.shape[1]
    for places in _PLACES:
        last = places[-1]
        number, real = letters[:, :n - last], letters[:, last:] > 0  # letters end where padding starts
        for at in places:
            number = number * SYMBOLS + letters[:, at:n - last + at]
        yield np.where(real, number, 0), DECAY ** (last + 1)


def described(letters: np.ndarray, columns: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Products of pieces with the columns of a table, normalised by the pieces' weights.

    ``columns`` gives the row of the table for each subsequence; row 0 is for all that it lacks, and holds zeros.
    """
    out, square = np.zeros((len(letters), *table.shape[1:])), np.zeros(len(letters))
    for number, weight in _subsequences(letters):
        square += weight ** 2 * (number > 0).sum(axis=1)
        row = columns[number]
        for k in range(row.shape[1]):
            out += weight * table[row[:, k]]
    return (out.T / np.sqrt(np.maximum(square, 1e-12))).T


def features(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, table): normalised weights of the pieces' subsequences, one column of the table per piece."""
    held = np.unique(np.concatenate([number.ravel() for number, _ in _subsequences(letters)]))
    held = held[held > 0]
    columns = np.zeros(SYMBOLS ** LETTERS, dtype=np.int32)
    columns[held] = np.arange(1, len(held) + 1)
    out, square = np.zeros((len(held) + 1, len(letters))), np.zeros(len(letters))
    for number, weight in _subsequences(letters):
        square += weight ** 2 * (number > 0).sum(axis=1)
        np.add.at(out, (columns[number], np.broadcast_to(np.arange(len(letters))[:, None], number.shape)), weight)
    out[0] = 0
    return columns, out / np.sqrt(np.maximum(square, 1e-12))


def kernel(a: str, b: str) -> float:
    """Likeness of two words of one piece each."""
    columns, table = features(_parts([a])[0])
    return float(described(_parts([b])[0], columns, table)[0, 0])


# ------------------------------------------------------------------ the machine
def _svm(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, penalty: float) -> np.ndarray:
    """Weights (the last one is the bias) of least squared hinge loss; each row counts so much for either side."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(60):
        m = x @ w
        up, down = np.where(m < 1, positive, 0), np.where(m > -1, negative, 0)
        held = up + down
        new = np.linalg.solve((x * held[:, None]).T @ x + ridge, x.T @ (up - down))
        if np.allclose(new, w, atol=1e-9):
            break
        w = (w + new) / 2 if _ > 30 else new  # steps that go back and forth are halved
    return w


@dataclass(frozen=True)
class Machine:
    """Subsequences with their weights, a bias, and slope and offset of the probability."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 0.0
    offset: float = 0.0

    @property
    def least(self) -> float:
        """Margin of a document without words."""
        return self.bias - float(np.abs(self.weights).max(initial=0.0)) * len(_PLACES) * WORD

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        columns = np.zeros(SYMBOLS ** LETTERS, dtype=np.int32)
        columns[self.numbers] = np.arange(1, len(self.numbers) + 1)
        return columns, np.r_[0.0, self.weights]

    def margins(self, words: list[str], table=None) -> list[float]:
        """Margin of each word, of its worst piece."""
        table = table or self.table()
        out = np.full(len(words), self.least)
        for at in range(0, len(words), 20_000):
            letters, owner = _parts(words[at:at + 20_000])
            if len(owner):
                np.maximum.at(out, at + owner, self.bias + described(letters, *table))
        return out.tolist()

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60))))


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def _whitened(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(columns, table) that describe pieces by their kernel with the landmarks, whitened."""
    columns, table = features(_first_pieces(words))
    values, vectors = np.linalg.eigh(table.T @ table)
    real = values > 1e-6 * values.max()
    return columns, table @ (vectors[:, real] / np.sqrt(values[real]))


def _first_pieces(words: list[str]) -> np.ndarray:
    letters, owner = _parts(words)
    return letters[np.searchsorted(owner, np.arange(len(words)))]  # one piece describes a word in training


def trained(witnesses: list[str], clean: dict[str, float], landmarks: int = LANDMARKS, penalty: float = PENALTY, strict: float = STRICT) -> Machine:
    """A machine that tells witnesses from words of clean sentences, of which each counts by a weight of its own."""
    others = sorted(clean, key=_hash)
    columns, table = _whitened([*witnesses[:landmarks // 2], *others[:landmarks - min(len(witnesses), landmarks // 2)]])
    words = [*witnesses, *others]
    x = np.vstack([described(_first_pieces(words[k:k + 4096]), columns, table) for k in range(0, len(words), 4096)])
    weights = np.array([clean[w] for w in others])
    for_toxic, for_clean = np.zeros(len(words)), np.zeros(len(words))
    for_toxic[:len(witnesses)] = 1 / len(witnesses)
    for_clean[len(witnesses):] = strict * weights / weights.sum()
    w = _svm(x, for_toxic, for_clean, penalty)
    return Machine(np.flatnonzero(columns), (table @ w[:-1])[1:], float(w[-1]))


def calibrated(machine: Machine, margins: np.ndarray, labels: np.ndarray) -> Machine:
    """Slope and offset by logistic regression of labels on margins."""
    spread = float(margins.std()) or 1.0
    x = np.column_stack([(margins - margins.mean()) / spread, np.ones(len(margins))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        held = np.maximum(p * (1 - p), 1e-6)
        w += np.linalg.solve((x * held[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (labels - p) - 1e-2 * w)
    slope = max(float(w[0]), 0.0) / spread
    return replace(machine, slope=slope, offset=float(w[1]) - slope * float(margins.mean()))


# ------------------------------------------------------------------ documents
def sentences_of(text: str) -> list[str]:
    """Sentences in pieces of so many words at most."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text):
        words = s.split()
        out += [" ".join(words[at:at + SENTENCE]) for at in range(0, len(words), SENTENCE)]
    return out


def _split(batches):
    """The words of each sentence, with digests of the document and of the three words of least digest."""
    names = ["label", "doc", "near", "words"]
    for batch in batches:
        out = {n: [] for n in names}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc = int.from_bytes(_hash(text), "little", signed=True)
            for sentence in sentences_of(text):
                words = sorted(w for w in set(tokens(sentence)) if codes(w))
                near = int.from_bytes(_hash("".join(h.hex() for h in sorted(map(_hash, words))[:3])), "little", signed=True)
                for n, v in zip(names, (label, doc, near, words)):
                    out[n].append(v)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=names)


def _worst(machine: Machine):
    """Per text: the margin of its worst word and that word."""

    def run(batches):
        kept: dict[str, float] = {}
        table = machine.table()
        for batch in batches:
            margins, worst = [], []
            for at in range(0, batch.num_rows, 256):
                bags = [set(tokens(t)) for t in batch.column(1)[at:at + 256].to_pylist()]
                new = list(set().union(*bags).difference(kept))
                if len(kept) + len(new) > KEPT:
                    kept.clear()
                    new = list(set().union(*bags))
                kept.update(zip(new, machine.margins(new, table)))
                for bag in bags:
                    top = max((kept[w] for w in bag), default=machine.least)
                    margins.append(top)
                    worst.append(min((w for w in bag if kept[w] == top), default=None) if top > machine.least else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margins, pa.float64()), pa.array(worst, pa.string())], names=["key", "margin", "worst"])

    return run


def held_out(key: str = "doc_id") -> Column:
    """Whether a checksum of the id keeps the row out of training; so does a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _bad(machine: Machine):
    """Words with their margins."""

    def run(batches):
        for batch in batches:
            margins = machine.margins(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margins, pa.float64())], names=["word", "clean", "margin"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_documents: int = MOST_DOCUMENTS, most_words: int = MOST_WORDS) -> tuple[Machine | None, float]:
    """(machine, share of label 1) from labelled documents that are not held out."""
    known = labels.where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = written(known.where("label IN (0, 1)"), "labels")
    share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents) for k in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])  # of bounded size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sample = written(texts.join(F.broadcast(ids), "doc_id").repartition(F.xxhash64("doc_id")).select("label", "text"), "toxicity-sample")

    # documents that hold a word, of copies of a sentence only one counted
    split = sample.mapInArrow(_split, "label int, doc long, near long, words array<string>")
    once = split.groupBy("label", "near").agg(F.min(F.struct("doc", "words")).alias("s"))
    met = once.select("label", "s.doc", F.explode("s.words").alias("word")).distinct()
    counts = written(met.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "words")
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not total["toxic"] or not total["clean"]:
        return None, float(share)
    expected = (F.col("clean") + 0.5) * total["toxic"] / total["clean"]
    surplus = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    judged = counts.withColumns({"surplus": surplus, "witness": (surplus > SURPLUS) & (F.col("toxic") > TIMES * expected)})
    witnesses = [r["word"] for r in judged.where("witness").orderBy(F.desc("surplus"), "word").limit(MOST_WITNESSES).collect()]
    if not witnesses:
        witnesses = [r["word"] for r in judged.orderBy(F.desc("surplus"), "word").limit(1).collect()]
    others = counts.where((F.col("clean") > 0) & ~F.col("word").isin(witnesses)).select("word", "clean")
    drawn = others.orderBy(F.xxhash64("word"), "word").limit(most_words)
    against = {r["word"]: float(r["clean"]) ** 0.5 for r in drawn.collect()}
    if not against:
        return None, float(share)
    machine = trained(witnesses, against)
    for _ in range(ROUNDS):  # clean words that this machine takes for toxic ones join the others
        bad = others.mapInArrow(_bad(machine), "word string, clean long, margin double").orderBy(F.desc("margin"), "word").limit(most_words // 10)
        against |= {r["word"]: HARD * float(r["clean"]) ** 0.5 for r in bad.collect()}
        machine = trained(witnesses, against)
    rows = sample.mapInArrow(_worst(machine), "key int, margin double, worst string").select("key", "margin").collect()  # one per sampled document
    return calibrated(machine, np.array([r["margin"] for r in rows]), np.array([r["key"] for r in rows], dtype=float)), float(share)


def scored(docs: DataFrame, machine: Machine | None, share: float = 0.0) -> DataFrame:
    """Per document: doc_id, score (probability of label 1), predicted, worst (its worst word in lower case)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), whole_text().alias("text"))
    if machine is None:
        rows = texts.select("key", F.lit(float(share)).alias("score"), F.lit(None).cast("string").alias("worst"))
    else:
        rows = texts.mapInArrow(_worst(machine), "key long, margin double, worst string")
        at = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("margin") * machine.slope + machine.offset))
        rows = rows.select("key", (1 / (1 + F.exp(-at))).alias("score"), "worst")
    return rows.select(F.col("key").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")

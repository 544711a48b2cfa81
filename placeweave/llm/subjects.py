"""Subject areas of documents by anchored non-negative factorisation of the term matrix.

Rows are sentences, tied to their document by its mixture; columns are hashed words. Some
components are anchored: one for each subject, seeded with the words that hand-labelled
documents of the subject use far more than others and with the words of its description. The
rest are a language's common words. Alternating multiplicative updates (Kullback-Leibler) fit the
components on a bounded sample of labelled documents, which may only use the components of their
subjects, the sums of a pass being added up by Spark. With the components fixed, the same updates
give every sentence of the corpus its mixture in one pass, where the text lies: a sentence belongs
to the subject whose component explains most of its words, if that is at least MOST_OF_A_WORD, and
a document has the subjects of at least a fifth of its sentences.
"""

from __future__ import annotations

import html
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import durable, spread

#: Columns of the term matrix.
BUCKETS = 131_071
#: Common components of each language.
COMMON = 4
#: Standard deviations by which a word must exceed its expected count to seed a subject.
SIGNIFICANT = 3.0
#: Times its expected count that it must also reach: in a large sample small differences are significant too.
MARKED = 2.0
#: Least share of a word's mass that a subject needs to keep the word.
SPECIFIC = 0.3
#: Words of a sentence that a subject's component must explain for the sentence to belong to it.
MOST_OF_A_WORD = 0.8
#: Documents that the components are fitted on, at most: those labelled, in the order of a hash of their ids.
MOST_LABELLED = 8_000
#: Passes over the sample; updates of the mixtures in a pass, and of the corpus's mixtures.
PASSES, STEPS, FOLD_STEPS = 3, 4, 6
#: Least weight that a component keeps when a sentence starts from its document's mixture.
FLOOR = 0.02
#: Words handled at once, which bounds a worker's memory whatever the batch; sentences whose words a worker keeps.
CHUNK, KEPT = 150_000, 1 << 16
#: Function words of Urdu in Latin letters.
ROMAN_URDU = frozenset("aaj aaye agle aur baad baghair bajay baqi bachon bohat bohot hai hain haftay hui ka kal karein ke khulta ki ko koi liye mein mumkin nahi naya par rakhein se shukriya subah walidain zaroori".split())
_ITEM = r"(?:[-*•]\s+|\[.?\]\s*|\d{1,2}:\d\d\s+|[QA]:\s*|\d+[.)]\s+)"
#: Words of two characters or more.
_WORD = re.compile(r"[^\W\d_]{2,}(?:['’][^\W\d_]+)?|[^\W\d_]['’][^\W\d_]+")
_TAG = re.compile(r"<[^<>]{1,60}>")
_BROKEN_LINE = re.compile(rf"(?<![.!?۔:\n])\n(?!\s*\n|\s*{_ITEM})")
_ITEMS = re.compile(rf"\s*(?:{_ITEM})+")
_BOUNDARY = re.compile(r"(?<=[.!?۔])\s+")
_ENDED = re.compile(r"[.!?۔][\"')\]]*\s*$")


def pieces(text: str | None) -> list[str]:
    """Sentences, items and lines of a text that hold a letter, in order, without marks of items. A line break inside a sentence is a blank."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    # paragraphs, items and lines behind an end mark begin anew
    text = _BROKEN_LINE.sub(" ", text)
    out = []
    for line in text.split("\n"):
        m = _ITEMS.match(line)
        out += _BOUNDARY.split(line[m.end() :] if m else line)
    return out


def words(piece: str) -> list[str]:
    return _WORD.findall(piece.lower())


def sentences(text: str | None) -> list[list[str]]:
    """Words in small letters of each sentence. A title, which is a first piece without an end mark before others, is none; any other piece is."""
    found = [(p, w) for p in pieces(text) if (w := words(p))]
    if len(found) > 1 and not _ENDED.search(found[0][0]):
        found = found[1:]
    return [w for _, w in found]


def language(words: list[str], ascii: bool = False) -> int:
    """0: any language without own words here, 1: Arabic script, 2: Urdu in Latin letters."""
    if not ascii and sum("؀" <= w[0] <= "ۿ" for w in words) * 2 >= len(words):
        return 1
    if ROMAN_URDU.isdisjoint(words):
        return 0
    return 2 if sum(w in ROMAN_URDU for w in words) * 4 >= len(words) else 0


LANGUAGES = 3


class Columns(dict):
    """The columns of words; emptied when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 8 * KEPT:
            self.clear()
        column = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return column


class Reader:
    """Texts to cells (language and hashed word) of their sentences; pieces that come again are looked up, a bounded number is kept."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}
        self.columns = Columns()

    def cells(self, piece: str) -> list[int]:
        found = words(piece)
        column = self.columns
        base = language(found, piece.isascii()) * BUCKETS if found else 0
        return [base + column[w] for w in found] if base else [column[w] for w in found]

    def read(self, text: str | None) -> list[list[int]]:
        """The cells of each sentence, in order, as sentences() divides the text."""
        out: list[list[int]] = []
        first = ""
        for piece in pieces(text):
            cells = self.known.get(piece)
            if cells is None:
                if len(self.known) >= KEPT:
                    self.known.clear()
                cells = self.cells(piece)
                if len(piece) < 1000:
                    self.known[piece] = cells
            if cells:
                first = first or piece
                out.append(cells)
        return out[1:] if len(out) > 1 and not _ENDED.search(first) else out


class Block:
    """Some documents as arrays: sentence of each word's cell, document and length of each sentence."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.subjects = [r[1] for r in rows]
        self.lengths = np.fromiter(itertools.chain.from_iterable(r[2] for r in rows), np.int64)
        self.cell = np.fromiter(itertools.chain.from_iterable(r[3] for r in rows), np.int64)
        self.per_doc = np.array([len(r[2]) for r in rows])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.doc_starts = np.concatenate([[0], np.cumsum(self.per_doc)[:-1]])
        self.sentence = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.doc = np.repeat(np.arange(len(rows)), self.per_doc)

    def by_sentence(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=0)

    def by_doc(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.doc_starts, axis=0)


def blocks(rows: Iterator[tuple]) -> Iterator[Block]:
    """Blocks of about CHUNK words from (id, subjects, lengths, cells); a document is never divided."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[3])
        if size >= CHUNK:
            yield Block(some)
            some, size = [], 0
    if some:
        yield Block(some)


def read_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(doc_id, subjects, lengths, cells) of the texts that hold words."""
    reader = Reader()
    for batch in batches:
        for i, text, tags in zip(batch["doc_id"], batch["text"], batch["subjects"] if "subjects" in batch else [()] * len(batch)):
            found = reader.read(text)
            if found:
                yield i, [] if tags is None else list(tags), [len(c) for c in found], list(itertools.chain.from_iterable(found))


SAMPLE = "doc_id long, subjects array<int>, lengths array<int>, cells array<int>"


def sample_rows(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The sample as rows of SAMPLE: at most ``most`` labelled documents (doc_id, subject_no), those whose ids hash lowest."""
    chosen = labels.groupBy("doc_id").agg(F.collect_set("subject_no").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    tagged = documents.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")  # at most ``most`` short rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(read_rows(iter([batch]))), columns=["doc_id", "subjects", "lengths", "cells"])

    return tagged.repartition(tagged.sparkSession.sparkContext.defaultParallelism, "doc_id").mapInPandas(run, SAMPLE)


def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[Block]:
    return blocks(row for batch in batches for row in zip(*(batch[c] for c in ("doc_id", "subjects", "lengths", "cells"))))


def _sums(total: np.ndarray) -> Iterator[pd.DataFrame]:
    """The cells of a task's sums that aren't zero."""
    cells = np.flatnonzero(total.any(axis=1))
    for i in range(0, len(cells), 20_000):
        part = cells[i : i + 20_000]
        yield pd.DataFrame({"cell": part, **{f"c{k}": total[part, k] for k in range(total.shape[1])}})


def _collect(sums: DataFrame, k: int) -> np.ndarray:
    """The sums of all tasks: at most LANGUAGES * BUCKETS rows, whatever the corpus."""
    out = np.zeros((LANGUAGES * BUCKETS, k), np.float64)
    rows = sums.groupBy("cell").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).toPandas()
    if len(rows):
        out[rows["cell"].to_numpy()] = rows[[f"c{i}" for i in range(k)]].to_numpy()
    return out


def _schema(k: int) -> str:
    return ", ".join(["cell long", *(f"c{i} double" for i in range(k))])


class Factors:
    """Term weights of all components by language, normed: an array (language, word, component)."""

    def __init__(self, subjects: int):
        self.subjects, self.k = subjects, subjects + COMMON
        self.h = np.zeros((LANGUAGES * BUCKETS, self.k), np.float32)

    def set(self, mass: np.ndarray, least: float) -> None:
        m = mass.reshape(LANGUAGES, BUCKETS, self.k) + least
        self.h = (m / m.sum(axis=1, keepdims=True)).reshape(-1, self.k).astype(np.float32)


class Model(NamedTuple):
    """What labelling needs of the factors: for each cell the row of its word, or -1 if it is common only; of each row the subjects' weights and that of common words."""

    row: np.ndarray
    h: np.ndarray
    common: np.ndarray


def _mixtures(b: Block, h: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture of each sentence of the sample after multiplicative updates, started from its document's, and the ratio x / (w h) of each word."""
    k = h.shape[1]
    allowed = np.ones((len(b.lengths), k), np.float32)
    for d, tags in enumerate(b.subjects):
        if len(tags):
            at = slice(b.doc_starts[d], b.doc_starts[d] + b.per_doc[d])
            allowed[at, :subjects] = 0
            allowed[at, list(tags)] = 1
    hc = h[b.cell]
    w = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(STEPS):
        ratio = 1 / ((w[b.sentence] * hc).sum(axis=1) + 1e-12)
        w = w * b.by_sentence(ratio[:, None] * hc)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
        if step < STEPS - 1 and step % 2:
            mix = b.by_doc(w) / b.per_doc[:, None]
            w = (mix[b.doc] + FLOOR) * allowed
            w /= w.sum(axis=1, keepdims=True)
    return w, 1 / ((w[b.sentence] * hc).sum(axis=1) + 1e-12)


def fold_in(b: Block, model: Model) -> np.ndarray:
    """Mixtures (sentence, subject) after multiplicative updates with the components fixed, each counted in words of the sentence.

    A word that no subject has adds exactly one to the common part at every update, so only the others are computed with.
    """
    n = model.h.shape[1]
    row = model.row[b.cell]
    at = np.flatnonzero(row >= 0)
    sentence, row = b.sentence[at], row[at]
    own, common = model.h[row], model.common[row]
    length = b.lengths.astype(np.float32)
    # sums of a sentence's marked words lie together; sentences without one stay zero
    some, first = np.unique(sentence, return_index=True)
    plain = length - np.bincount(sentence, minlength=len(length))
    w = np.full((len(length), n), 1 / (n + 1), np.float32)
    c = np.full(len(length), 1 / (n + 1), np.float32)
    for step in range(FOLD_STEPS):
        ratio = 1 / ((w[sentence] * own).sum(axis=1) + c[sentence] * common + 1e-12)
        up, also = np.zeros_like(w), np.zeros_like(c)
        if len(some):
            up[some] = np.add.reduceat(ratio[:, None] * own, first, axis=0)
            also[some] = np.add.reduceat(ratio * common, first)
        w, c = w * up / length[:, None], (c * also + plain) / length
        if step < FOLD_STEPS - 1 and step % 2:
            per = b.per_doc[:, None]
            w = (b.by_doc(w) / per)[b.doc] + FLOOR
            c = (b.by_doc(c) / b.per_doc)[b.doc] + FLOOR
            total = w.sum(axis=1) + c
            w, c = w / total[:, None], c / total
    return w * length[:, None]


def fit(sample: DataFrame, subjects: list[tuple[str, str]]) -> Model:
    """The components of a sample (rows of SAMPLE, durable) with one anchored component for each (name, description)."""
    n = len(subjects)
    f = Factors(n)
    sc = sample.sparkSession.sparkContext

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # by subject: words of labelled documents, shared out over their labels; then all words
        total = np.zeros((LANGUAGES * BUCKETS, n + 1), np.float32)
        for b in sampled(batches):
            share = np.zeros((len(b.ids), n + 1), np.float32)
            share[:, n] = 1
            for d, tags in enumerate(b.subjects):
                share[d, list(tags)] = 1 / len(tags)
            weight = share[b.doc[b.sentence]]
            for k in range(n + 1):
                total[:, k] += np.bincount(b.cell, weights=weight[:, k], minlength=len(total))
        yield from _sums(total)

    counts = _collect(sample.mapInPandas(seeds, _schema(n + 1)), n + 1).reshape(LANGUAGES, BUCKETS, n + 1)
    mass = np.zeros((LANGUAGES, BUCKETS, f.k))
    rng = np.random.default_rng(11)
    for lang in range(LANGUAGES):
        every = counts[lang, :, n]
        common = every[:, None] * rng.uniform(0.7, 1.3, (BUCKETS, COMMON))
        for k, (_, description) in enumerate(subjects):
            own = counts[lang, :, k]
            if own.sum():
                expected = every * (own.sum() / every.sum())
                more = ((own - expected) / np.sqrt(expected + 0.5) > SIGNIFICANT) & (own >= MARKED * expected)
                mass[lang, more, k] = (own - expected)[more]
                common[more] *= 0.05
            if lang == 0:
                for w in _WORD.findall(description.lower()):
                    if len(w) > 3:
                        mass[lang, zlib.crc32(w.encode()) % BUCKETS, k] += 0.5
        mass[lang, :, n:] = common
    sums = mass.sum(axis=1, keepdims=True)
    f.set((mass / np.maximum(sums, 1e-12)).reshape(-1, f.k), 1e-6)
    mass = mass.reshape(-1, f.k)

    for _ in range(PASSES):
        shared = sc.broadcast(f.h)  # its size depends on BUCKETS and the number of subjects only

        def one_pass(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            h = shared.value
            total = np.zeros(h.shape, np.float32)
            for b in sampled(batches):
                w, ratio = _mixtures(b, h, n)
                part = ratio[:, None] * w[b.sentence]
                for k in range(h.shape[1]):
                    total[:, k] += np.bincount(b.cell, weights=part[:, k], minlength=len(total))
            total *= h
            yield from _sums(total)

        found = _collect(sample.mapInPandas(one_pass, _schema(f.k)), f.k)
        shared.unpersist()
        if not found.any():
            break  # no labelled document has words: the descriptions alone are the components
        mass = found
        f.set(mass, 1e-4)
    # words that a subject shares with many others aren't its own
    low = mass < SPECIFIC * mass.sum(axis=1, keepdims=True)
    low[:, n:] = False
    moved = np.where(low, mass, 0).sum(axis=1)
    mass = np.where(low, 0, mass)
    mass[:, n:] += moved[:, None] / COMMON
    f.set(mass, 1e-4)
    marked = np.flatnonzero(mass[:, :n].sum(axis=1) > 0)
    row = np.full(len(mass), -1, np.int32)
    row[marked] = np.arange(len(marked))
    return Model(row, f.h[marked, :n], f.h[marked, n:].mean(axis=1))


def _subjects(subject: DataFrame) -> list[tuple[str, str]]:
    listed = [(r["subject"], r["description"] or "") for r in subject.where(F.col("subject").isNotNull()).orderBy("subject").limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1,000 subjects")
    return listed


def document_subjects(documents: DataFrame, labels: DataFrame, subject: DataFrame, share: float = 0.2, most_labelled: int = MOST_LABELLED, mixtures: bool = False) -> DataFrame:
    """(doc_id, subject): the subjects of at least ``share`` of a document's sentences. Null, empty and wordless texts have none.

    labels: (doc_id, subject), some of them wrong; unknown subjects in it are ignored. The components are fitted on at most ``most_labelled``
    of the labelled documents; every document is labelled, and depends on no other one. The list of subjects must be short.
    With mixtures the rows are (doc_id, subject, share), the part of a document's words that each subject's component explains, where not 0.
    """
    listed = _subjects(subject)
    spark = documents.sparkSession
    out = "doc_id long, subject string" + (", share double" if mixtures else "")
    if not listed:
        return spark.createDataFrame([], out)
    numbers = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(listed)], "subject string, subject_no int")
    model = fit(durable(sample_rows(documents, labels.select("doc_id", "subject").join(numbers, "subject").distinct(), most_labelled)), listed)
    shared, n, names = spark.sparkContext.broadcast(model), len(listed), np.asarray([s for s, _ in listed], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(read_rows(batches)):
            mass = fold_in(b, shared.value)
            ids = np.asarray(b.ids)
            if mixtures:
                part = b.by_doc(mass) / b.by_doc(b.lengths)[:, None]
                d, k = np.nonzero(part > 1e-4)
                yield pd.DataFrame({"doc_id": ids[d], "subject": names[k], "share": part[d, k].astype(float)})
                continue
            top = np.where(mass.max(axis=1) >= MOST_OF_A_WORD, mass.argmax(axis=1), n)
            hit = np.zeros((len(top), n + 1), np.int64)
            hit[np.arange(len(top)), top] = 1
            d, k = np.nonzero(b.by_doc(hit)[:, :n] >= share * b.per_doc[:, None] - 1e-9)
            yield pd.DataFrame({"doc_id": ids[d], "subject": names[k]})

    texts = spread(documents.select("doc_id", "text").where(F.length("text") > 0), "doc_id")
    return texts.mapInPandas(run, out)

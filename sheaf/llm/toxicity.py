"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index of all terms; weighted votes, calibrated."""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.bpe import Numbered, spread
from sheaf.llm.common import arrow_limits, built, slices, token

WORDS = re.compile(r"[^\W\d_]+")
#: Examples of a block of the index; blocks that are summed before the others' bounds are looked at.
BLOCK, FIRST_BLOCKS = 64, 2
PREFIXES = (4, 5, 6)


def terms_of(word: str) -> tuple[str, ...]:
    """A word stands for itself and for its first four, five and six letters, if it is longer than that."""
    return (word, *("^" + word[:n] for n in PREFIXES if len(word) > n))


def term_counts(text: str) -> dict[str, int]:
    words, out = Numbered(), {}
    codes = np.fromiter(map(words.__getitem__, WORDS.findall(text.lower())), np.int64)
    for word, n in zip(words, np.bincount(codes).tolist(), strict=True):
        for term in terms_of(word):
            out[term] = out.get(term, 0) + n
    return out


@dataclass
class Index:
    """Postings of the examples by term: every term of every example, none left out. Examples stand in blocks; the largest
    value of a term in each block bounds the cosines of a block's examples from above."""

    terms: dict[str, int]
    idf: np.ndarray  # times the strength of the term, if strengths are given
    ids: list[str]
    labels: np.ndarray
    weights: np.ndarray  # of a vote, by the share of the class that was sampled
    examples: np.ndarray  # postings, by term and example
    values: np.ndarray
    starts: np.ndarray  # by term and block, and the end
    tops: np.ndarray  # float32, largest value by term and block
    k: int
    prior: float
    steps: tuple[np.ndarray, np.ndarray]  # raw vote to calibrated score

    def pack(self) -> bytes:
        """What is broadcast: terms, weights and postings; the blocks follow from them."""
        sizes = np.diff(self.starts[:: self.tops.shape[1]]) if self.terms else np.zeros(0, np.int32)
        names = "\n".join(self.terms)  # terms have letters only, but for the sign of a prefix
        numbers = np.fromiter(self.terms.values(), np.int32, len(self.terms))
        return zlib.compress(pickle.dumps((names, numbers, self.idf, self.ids, self.labels, self.weights, self.examples, self.values, sizes, self.k, self.prior, self.steps)), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        names, numbers, idf, ids, labels, weights, examples, values, sizes, k, prior, steps = pickle.loads(zlib.decompress(data))
        terms = dict(zip(names.split("\n"), numbers.tolist(), strict=True)) if len(numbers) else {}
        return cls(terms, idf, ids, labels, weights, examples, values, *cls.blocks(len(terms), len(ids), np.repeat(np.arange(len(sizes)), sizes), examples, values), k, prior, steps)

    @staticmethod
    def blocks(terms: int, ids: int, term: np.ndarray, example: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and tops of postings in order of term and example."""
        n = max(1, -(-ids // BLOCK))
        cell = term * n + example // BLOCK
        starts = np.searchsorted(cell, np.arange(terms * n + 1)).astype(np.int32)
        tops = np.zeros(terms * n, np.float32)
        np.maximum.at(tops, cell, np.nextafter(value.astype(np.float32), np.float32(2)))
        return starts, tops.reshape(terms, n)

    @classmethod
    def build(cls, ids: list[str], labels: np.ndarray, weights: np.ndarray, vectors: list[dict[str, int]], document_counts: dict[str, int], k: int) -> Index:
        terms = {t: i for i, t in enumerate(sorted(document_counts))}
        idf = np.log((1 + len(ids)) / np.array([document_counts[t] for t in terms], float)) if terms else np.zeros(0)
        found = [(terms[t], j, n) for j, v in enumerate(vectors) for t, n in v.items() if t in terms]
        term, example, n = np.array(found, np.int64).reshape(-1, 3).T
        return cls.of(ids, labels, weights, terms, idf, term, example, n, k)

    @classmethod
    def of(cls, ids: list[str], labels: np.ndarray, weights: np.ndarray, terms: dict[str, int], idf: np.ndarray, term: np.ndarray, example: np.ndarray, n: np.ndarray, k: int) -> Index:
        """From the counts `n` of each term in each example, a pair at most once."""
        order = np.lexsort((term, example))
        term, example, n = term[order], example[order], n[order]
        cuts = np.searchsorted(example, np.arange(len(ids) + 1))
        vectors = [(term[x:y], cls.scaled(idf, term[x:y], n[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        value = np.concatenate([np.zeros(0), *(q for _, q in vectors)])
        order = np.lexsort((example, term))
        term, example, value = term[order], example[order], value[order]
        prior = float((weights * labels).sum() / max(weights.sum(), 1e-9))
        index = cls(terms, idf, ids, labels, weights, example.astype(np.int32), value, *cls.blocks(len(terms), len(ids), term, example, value), k, prior, (np.zeros(1), np.zeros(1)))
        index._calibrate(vectors)
        return index

    @staticmethod
    def scaled(idf: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of the terms that a text holds so often, of unit length."""
        q = (1 + np.log(n)) * idf[at]
        norm = np.sqrt((q * q).sum())
        return q / norm if norm > 0 else q

    @classmethod
    def unit(cls, terms: dict[str, int], idf: np.ndarray, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights, of unit length."""
        found = [(terms[t], n) for t, n in counts.items() if t in terms]
        at = np.array([t for t, _ in found], np.int64)
        return at, cls.scaled(idf, at, np.array([n for _, n in found], float))

    def sums(self, at: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of the examples of these blocks (zero for all others), from their postings of these terms."""
        every = self.tops.shape[1]
        if 2 * len(blocks) > every:  # a term's postings of all blocks stand together
            first, last = self.starts[at * every], self.starts[at * every + every]
        else:
            cells = (at[:, None] * every + blocks).ravel()
            first, last = self.starts[cells], self.starts[cells + 1]
            q = np.repeat(q, len(blocks))
        some = np.flatnonzero(last > first)
        first, sizes = first[some].astype(np.int64), (last[some] - first[some]).astype(np.int64)
        place = spread(first, sizes)
        return np.bincount(self.examples[place], self.values[place] * np.repeat(q[some], sizes), len(self.ids))

    def nearest(self, at: np.ndarray, q: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above zero, exactly (ties: the earlier example): blocks with the largest bounds
        first, then only those whose bound reaches the k-th cosine so far."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = q.astype(np.float32) @ self.tops[at] * np.float32(1.0001)
        order = np.argsort(-bounds, kind="stable")
        # where most bounds are alike nothing can be passed over: all blocks at once
        first = len(order) if 2 * np.count_nonzero(bounds >= 0.6 * bounds[order[0]]) > len(order) else FIRST_BLOCKS
        cosines = self.sums(at, q, order[:first])
        if without >= 0:
            cosines[without] = 0
        kth = np.partition(cosines, -self.k)[-self.k] if len(cosines) > self.k else 0.0
        more = order[first:]
        more = more[bounds[more] >= max(kth - 1e-9, 1e-30)]
        if len(more):
            cosines = self.sums(at, q, order) if 2 * len(more) > len(order) else cosines + self.sums(at, q, more)
            if without >= 0:
                cosines[without] = 0
        ranks = np.round(cosines, 12)
        least = np.partition(ranks, -self.k)[-self.k] if len(ranks) > self.k else 0
        found = np.flatnonzero((ranks >= least) & (cosines > 0))
        found = found[np.lexsort((found, -ranks[found]))[: self.k]]
        return found, cosines[found]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Votes weighted by squared cosine, pulled a little towards the prior."""
        w = cosines**2 * self.weights[found]
        return float(((w * self.labels[found]).sum() + 0.1 * self.prior) / (w.sum() + 0.1))

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic regression of the label on the vote that each example gets from the others, joined up between the middles of its levels."""
        votes = np.array([self.vote(*self.nearest(*v, without=j)) for j, v in enumerate(vectors)])
        levels: list[list[float]] = []  # weight, weighted label, lowest and highest vote
        for j in np.argsort(votes, kind="stable").tolist():
            levels.append([self.weights[j], self.weights[j] * self.labels[j], votes[j], votes[j], self.weights[j] * votes[j]])
            while len(levels) > 1 and (levels[-2][3] == levels[-1][2] or levels[-2][1] * levels[-1][0] >= levels[-1][1] * levels[-2][0]):
                w, y, _, top, v = levels.pop()
                levels[-1] = [levels[-1][0] + w, levels[-1][1] + y, levels[-1][2], top, levels[-1][4] + v]
        if levels:
            at = [0.0, *(v / w for w, _, _, _, v in levels), 1.0]
            to = [(y + 0.5 * self.prior) / (w + 0.5) for w, y, _, _, _ in levels]
            self.steps = np.array(at), np.array([to[0] * 0.5, *to, to[-1] + 0.5 * (1 - to[-1])])

    def score(self, at: np.ndarray, counts: np.ndarray) -> tuple[float, list[dict]]:
        """From the known terms of a text and how often it holds each."""
        if not self.ids:
            return 0.0, []
        found, cosines = self.nearest(at, self.scaled(self.idf, at, counts))
        evidence = [{"id": self.ids[j], "cosine": float(c), "toxic": int(self.labels[j])} for j, c in zip(found[:3].tolist(), cosines[:3].tolist(), strict=True)]
        return float(np.clip(np.interp(self.vote(found, cosines), *self.steps), 0, 1)), evidence


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1000, least_strength: float = 0.001, k: int = 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """An index of about `per_class` labelled texts of each class, over all their terms.

    The sample is by hash of the id, so it doesn't depend on the layout. Terms are counted on the executors, and the counts of
    the sample reach the driver, packed by text. No term is dropped: its idf is multiplied by its strength, the association
    (phi) of its presence with the label, at least `least_strength`, so that words that say nothing of the label hardly count
    and yet every known word finds neighbours. An id with several labels takes the largest, one with several texts the largest
    counts; rows with a null id, label or text teach nothing; no labels give an empty index.
    """
    arrow_limits(docs.sparkSession)
    none = Index.build([], np.zeros(0), np.zeros(0), [], {}, k)
    given = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if not sizes:
        return none
    share = F.create_map([F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, per_class / n))])
    sample = given.where(F.col("toxic").isin(*sizes)).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("toxic")] * (1 << 20))
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches):
            found = [term_counts(text.decode("utf-8", "replace")) for text in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["id", "toxic", "terms", "n"])

    rows = texts.mapInArrow(count, "id string, toxic int, terms array<string>, n array<long>").toArrow().combine_chunks()  # about 2 * per_class texts
    keys = list(zip(rows["id"].to_pylist(), rows["toxic"].to_pylist(), strict=True))
    ids = sorted(set(keys))
    toxic = np.array([t for _, t in ids], float)
    n1 = float(toxic.sum())
    n0 = len(ids) - n1
    if not n1 or not n0:
        return none
    number = {x: j for j, x in enumerate(ids)}
    of_row = np.array([number[x] for x in keys], np.int64)
    names, example, n = [], [], []
    terms: dict[str, int] = Numbered()
    for j, own, counts in zip(of_row.tolist(), rows["terms"], rows["n"], strict=True):
        codes = np.fromiter(map(terms.__getitem__, own.as_py()), np.int64)
        names.append(codes)
        example.append(np.full(len(codes), j))
        n.append(np.array(counts.as_py(), np.int64))
    term, example, n = (np.concatenate(x) for x in (names, example, n))
    order = np.lexsort((-n, example, term))  # texts of one id: the largest count
    term, example, n = term[order], example[order], n[order]
    first = np.concatenate([[True], (term[1:] != term[:-1]) | (example[1:] != example[:-1])])[: len(term)]
    term, example, n = term[first], example[first], n[first]
    df = np.bincount(term, minlength=len(terms)).astype(float)
    a = np.bincount(term, toxic[example], len(terms))
    phi = np.abs(a * n0 - (df - a) * n1) / np.sqrt(n1 * n0 * df * np.maximum(n1 + n0 - df, 0.5))
    weights = np.where(toxic == 1, sizes.get(1, 0) / n1, sizes.get(0, 0) / n0)
    idf = np.log((1 + len(ids)) / df) * np.maximum(phi, least_strength)
    return Index.of([i for i, _ in ids], toxic, weights, dict(terms), idf, term, example, n, k)


def score(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, score (0 to 1), predicted (1 if score >= 0.5) and evidence (the nearest examples) of every whole text.

    A row per input row and no shuffle; the broadcast index is bounded by fit(). A null, empty or wordless text, or one
    without any known term, gets the calibrated score of the prior; an empty index scores 0. A null id stays null; repeated
    rows give repeated results; other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string")).toDF("id", "text")
    shared, key = docs.sparkSession.sparkContext.broadcast(index.pack()), token()
    kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader = built(key, lambda: Reader(Index.unpack(shared.value)))  # type: ignore[assignment]
        for batch, texts in slices(batches):
            found = reader.score([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([e for _, e in found], kind)], names=["id", "score", "predicted", "evidence"])

    schema = f"id {frame.schema['id'].dataType.simpleString()}, score double, predicted int, evidence array<struct<id:string,cosine:double,toxic:int>>"
    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Reader:
    """Scores texts, keeping the known terms of words (up to a bound)."""

    def __init__(self, index: Index):
        self.index = index
        self._forget()

    def _forget(self) -> None:
        self.known, self.terms, self.starts = Numbered(), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def score(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        if len(self.known) > 200_000:
            self._forget()
        known, before, numbers = self.known, len(self.known), self.index.terms
        coded = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in (WORDS.findall(t.lower()) for t in texts)]
        if len(known) > before:
            found = [[numbers[t] for t in terms_of(w) if t in numbers] for w in itertools.islice(known, before, None)]
            self.terms = np.concatenate([self.terms, np.fromiter(itertools.chain.from_iterable(found), np.int64)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return [self._score(*np.unique(codes, return_counts=True)) for codes in coded]

    def _score(self, codes: np.ndarray, counts: np.ndarray) -> tuple[float, list[dict]]:
        sizes = self.starts[codes + 1] - self.starts[codes]
        at, which = np.unique(self.terms[spread(self.starts[codes], sizes)], return_inverse=True)
        return self.index.score(at, np.bincount(which, np.repeat(counts, sizes), len(at)))

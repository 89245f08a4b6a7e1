"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.bpe import Numbered, spread
from sheaf.llm.common import arrow_limits, built, slices, token, whole_row, with_fields

WORDS = re.compile(r"[^\W\d_]+")
#: Starts of blocks of letters and the script from there on; code points before the first are Latin.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFEFF, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_NAMES = sorted({name for _, name in SCRIPT_STARTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPT_STARTS])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted trigrams
    scores: np.ndarray  # float32, a row per key and a last one for unseen trigrams
    scripts: np.ndarray  # bool, script by language


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams of the words (blank before and after each), how many each word has, each word's main script."""
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    keys = flat[:-2] << 42 | flat[1:-1] << 21 | flat[2:]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    kinds = _SCRIPT[np.searchsorted(_STARTS, flat, "right") - 1]
    return keys[spread(starts, sizes)], sizes, kinds[starts + 1 + sizes // 2]


def is_word(word: str) -> bool:
    return any(map(str.isalpha, word))


def words_of(text: str) -> list[str]:
    return [w for w in WORDS.findall(text.lower()) if w.isalpha() or is_word(w)]


def train(docs: DataFrame, *, per_language: int = 1500, grams_per_language: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram scores and scripts of each language, from about `per_language` whole texts of each.

    The sample is the rows whose hash of the id lies below the language's share, so it doesn't depend on the layout; counts
    are summed on the executors, and at most `grams_per_language` trigrams of each language reach the driver. Rows with a
    null text, language or id teach nothing; without any rows the model has no language.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).extend(words_of(text.decode("utf-8", "replace")))
            for lang, words in by.items():
                if not words:
                    continue
                keys, lengths, kinds = trigrams(words)
                found, counts = np.unique(keys, return_counts=True)
                letters = np.bincount(kinds, lengths, len(_NAMES)).astype(np.int64)
                found, counts = np.concatenate([found, -1 - np.arange(len(_NAMES))]), np.concatenate([counts, letters])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(counts)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.col("gram") < 0), F.desc("n"), "gram"))
    every = counts.withColumn("place", place).where(F.col("place") <= grams_per_language + len(_NAMES)).select("lang", "gram", "n").toArrow()
    owner, grams, n = (every.column(i).to_pandas().to_numpy() for i in range(3))
    languages, tables, scripts = sorted(sizes), [], np.zeros((len(_NAMES), len(sizes)), bool)
    for j, lang in enumerate(languages):
        gram, own = grams[owner == lang].astype(np.int64), n[owner == lang].astype(np.int64)
        letters = np.zeros(len(_NAMES))
        letters[-1 - gram[gram < 0]] = own[gram < 0]
        scripts[:, j] = letters >= 0.02 * max(1.0, letters.sum())
        tables.append((gram[gram >= 0], own[gram >= 0]))
    keys = np.unique(np.concatenate([g for g, _ in tables]))
    scores = np.zeros((len(keys) + 1, len(languages)), np.float32)
    for j, (gram, n) in enumerate(tables):
        have = np.full(len(keys) + 1, 0.4)
        have[np.searchsorted(keys, gram)] += n
        scores[:, j] = np.log(have / have.sum())
    return Model(languages, keys, scores, scripts)


class Scorer:
    """Per-word scores of a model; a worker forgets the words it has scored beyond a bound."""

    def __init__(self, model: Model, penalty: float, floor: float = 12.0):
        self.model, self.penalty, self.floor = model, np.float32(penalty), floor
        self._forget()

    def _forget(self) -> None:
        self.known, self.table, self.sizes = Numbered(), np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int64)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys, sizes, kinds = trigrams(words)
        at = np.searchsorted(self.model.keys, keys)
        at[at == len(self.model.keys)] = 0
        seen = self.model.keys[at] == keys if len(self.model.keys) else np.zeros(len(keys), bool)
        rows = self.model.scores[np.where(seen, at, len(self.model.keys))]
        sums = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0)
        allowed = self.model.scripts[kinds]
        allowed |= ~allowed.any(1, keepdims=True)  # a script that no language uses narrows nothing
        sums = np.where(allowed, sums, -np.inf)
        return np.maximum(sums - sums.max(1, keepdims=True), -self.floor).astype(np.float32), sizes

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language of each word of each text: Viterbi in step over all texts at once, longest first."""
        if len(self.known) > 200_000:
            self._forget()
        before = len(self.known)
        codes = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in texts]
        if len(self.known) > before:
            table, sizes = self.score(list(self.known)[before:])
            self.table, self.sizes = np.concatenate([self.table, table]), np.concatenate([self.sizes, sizes])
        lengths = np.array([len(c) for c in codes])
        order = np.argsort(-lengths, kind="stable")
        order = order[: int((lengths > 0).sum())]
        out = [np.zeros(len(c), np.int64) for c in codes]
        self.codes = codes
        if not len(order):
            return out
        long = lengths[order]
        active = np.searchsorted(-long, -np.arange(long[0]), "left")  # texts longer than t
        offset = np.cumsum(active) - active
        place = np.concatenate([offset[:n] + i for i, n in enumerate(long.tolist())])
        scores = np.empty((len(place), self.table.shape[1]), np.float32)
        scores[place] = self.table[np.concatenate([codes[i] for i in order])]
        state = np.zeros((len(order), scores.shape[1]), np.float32)
        switched, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
        for a, n in zip(offset.tolist(), active.tolist(), strict=True):
            s = state[:n]
            best = s.argmax(1)
            top = s[np.arange(n), best] - self.penalty
            source[a : a + n] = best
            np.greater(top[:, None], s, out=switched[a : a + n])
            np.maximum(s, top[:, None], out=s)
            s += scores[a : a + n]
        now = state.argmax(1)
        labels = np.empty(len(scores), np.int64)
        for a, n in zip(offset[::-1].tolist(), active[::-1].tolist(), strict=True):
            here = now[:n]
            labels[a : a + n] = here
            jump = switched[a : a + n][np.arange(n), here]
            now[:n] = np.where(jump, source[a : a + n], here)
        labels = labels[place]
        ends = np.cumsum(long)
        for i, (a, b) in zip(order.tolist(), zip((ends - long).tolist(), ends.tolist(), strict=True), strict=True):
            out[i] = labels[a:b]
        return out


def predict(docs: DataFrame, model: Model, *, penalty: float = 9.0, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The language of every whole text: the id column, lang_pred, score (0 to 1: the share of letters under that label) and
    spans (first word, last word, language) of mixed text.

    A row per input row and no shuffle; the broadcast model is bounded by train(). A text that is null, has no letter, or
    meets a model without languages is `und` with score 0 and no spans. Ties go to the first language by name. A null id stays
    null; repeated rows give repeated results; other columns are ignored, or come along unchanged, as `text` and the struct `row`, if `carry`.
    """
    arrow_limits(docs.sparkSession)
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *whole_row(docs.drop(text_col), carry))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), token()
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = built(key, lambda: Scorer(shared.value, penalty))  # type: ignore[assignment]
        names = scorer.model.languages
        for batch, texts in slices(batches):
            words = [words_of(t.decode("utf-8", "replace")) for t in texts] if names else [[] for _ in texts]
            found, scores, spans = [], [], []
            for labels, codes in zip(scorer.label(words), scorer.codes, strict=True):
                if not len(labels):
                    found.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                weight = np.bincount(labels, scorer.sizes[codes], len(names))
                best = int(weight.argmax())
                found.append(names[best])
                scores.append(float(weight[best] / weight.sum()))
                cuts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]]))
                spans.append([{"first": int(a), "last": int(b) - 1, "lang": names[int(labels[a])]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind), *batch.columns[1 if carry else 2 :]], names=["id", "lang_pred", "score", "spans", *batch.schema.names[1 if carry else 2 :]])

    schema = f"id {frame.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"
    return frame.mapInArrow(run, with_fields(schema, frame.schema.fields[1 if carry else 2 :])).withColumnRenamed("id", id_col)


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))

"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text; sharded count joins give perplexities.

The model is of characters, four at a time, over a bounded alphabet (the commonest characters have codes of their own, all others share
as many codes by their number, so a 4-gram is an exact 44-bit key). Documents send their (4-gram, count) pairs to the shards, packed by
4-gram; a shard is named by the two middle characters, so the 4-gram abcd, its context abc, the lower 4-gram's bcd and its context
bc, all that back-off needs, meet in it; for common pairs also by the first character, with the lower tables in each such shard. The
requests of a shard are dealt to as many tasks as their amount asks for, each with the shard's tables. Below that stands the bigram table, whose
size the alphabet bounds. Neither the counts of the corpus nor the model are ever in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import arrow_limits, checkpointed, slices

#: Codes of the alphabet: 1 for the place before the text, from 2 the commonest characters, from SHARED all others by number.
BITS, START, SHARED = 11, 1, 1 << 10
MASK = (1 << BITS) - 1
DOCUMENT_BITS = 20
#: Into how many shards a common pair goes, and the text whose requests one task answers, about.
SPLIT, TASK_BYTES = 4, 1 << 30


@dataclass(frozen=True)
class Model:
    codes: np.ndarray  # code of each UTF-16 unit
    bigrams: np.ndarray  # float32, log P2[c, d]
    table: DataFrame  # shard, kind, key, value
    shards: int
    common: np.ndarray  # middle pairs that go by the first character as well


def units(text: bytes) -> np.ndarray:
    """Lower-cased characters with white space squeezed, as UTF-16 units."""
    return np.frombuffer(" ".join(text.decode("utf-8", "replace").lower().split()).encode("utf-16-le", "surrogatepass"), np.uint16)


def grams(texts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of 4-grams, document numbers and counts, sorted by key and document; characters of each text."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = codes[units(text)]
        sizes[i] = len(own)
        if len(own):
            x = np.concatenate([np.full(3, START, np.uint64), own])
            keys = x[:-3] << np.uint64(3 * BITS) | x[1:-2] << np.uint64(2 * BITS) | x[2:-1] << np.uint64(BITS) | x[3:]
            parts.append(keys << np.uint64(DOCUMENT_BITS) | np.uint64(i))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
    every = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.append(first, len(every)))
    every = every[first]
    return every >> np.uint64(DOCUMENT_BITS), (every & np.uint64((1 << DOCUMENT_BITS) - 1)).astype(np.int64), counts, sizes


def alphabet(trusted: DataFrame, size: int = 1 << BITS) -> np.ndarray:
    """Codes of all UTF-16 units: the commonest of the texts, by count and then by unit, have their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for _, texts in slices(batches):
            for text in texts:
                found = units(text)
                total += np.bincount(found, minlength=1 << 16) if len(found) > 30_000 else 0
                if len(found) <= 30_000:
                    values, n = np.unique(found, return_counts=True)
                    total[values] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["unit", "n"])

    top = trusted.select("text").mapInArrow(count, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(SHARED - 2).collect()
    codes = SHARED + np.arange(1 << 16, dtype=np.uint64) % (size - SHARED)
    for code, row in enumerate(top, 2):
        codes[row["unit"]] = code
    return codes


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and above, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, n) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def train(trusted: DataFrame, *, shards: int = 12, size: int = 1 << BITS) -> Model:
    """The model of the column `text`. Counts of all trusted texts are summed (combined before the shuffle)."""
    arrow_limits(trusted.sparkSession)
    trusted = trusted.select(F.col("text").cast("string").alias("text")).where("text is not null")
    codes = alphabet(trusted, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            keys, _, counts, _ = grams(texts, codes)
            if len(keys):
                cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[cuts].view(np.int64)), pa.array(np.add.reduceat(counts, cuts), pa.int64())], names=["key", "n"])

    four = trusted.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    four = checkpointed(four)
    tail = lambda bits: F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    three = four.groupBy(tail(3 * BITS).alias("key")).agg(F.count("*").alias("n"))  # Kneser-Ney: in how many contexts it occurs
    two = three.groupBy(tail(2 * BITS).alias("key")).agg(F.count("*").alias("n"))
    levels = []
    for table in (four, three, two):
        c = table.agg(*[F.expr(f"count_if(n = {k})") for k in range(1, 5)]).first()
        d1, d2, d3 = discounts(*c)
        off = F.expr(f"CASE n WHEN 1 THEN {d1!r}D WHEN 2 THEN {d2!r}D ELSE {d3!r}D END")
        context = F.shiftright("key", BITS)
        sums = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("held")).select("context", "total", (F.col("held") / F.col("total")).alias("gamma"))
        levels.append((table.select("key", context.alias("context"), (F.col("n") - off).alias("own")), sums))
    (own4, sums4), (own3, sums3), (own2, sums2) = levels

    n1 = np.zeros(size)
    gamma2, p2 = np.ones(size), np.zeros((size, size))
    for row in two.groupBy(tail(BITS).alias("d")).agg(F.count("*").alias("n")).toLocalIterator():  # at most `size` rows
        n1[row["d"]] = row["n"]
    p1 = (n1 + 0.5) / (n1 + 0.5).sum()
    for row in sums2.toLocalIterator():
        gamma2[row["context"]] = row["gamma"]
    seen = own2.join(sums2, "context").select("key", (F.col("own") / F.col("total")).alias("p")).toArrow()  # at most size * size rows
    p2[:] = gamma2[:, None] * p1[None, :]
    keys = seen.column(0).to_numpy()
    p2[keys >> BITS, keys & MASK] += seen.column(1).to_numpy()

    pair = lambda c, bits: F.shiftright(c, bits).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    sums = four.groupBy(pair("key", BITS).alias("pair")).agg(F.sum("n").alias("n"))
    total = four.agg(F.sum("n")).first()[0] or 0
    common = [r["pair"] for r in sums.where(F.col("n") * (4 * shards) > total).select("pair").collect()]  # at most 4 * shards

    def shard(middle: Column, first: Column | None) -> Column:
        """The shards of a pair: by the first character too, or all of these where there is none, if the pair is common."""
        parts = F.array(*[F.lit(i).cast("long") for i in range(SPLIT)]) if first is None else F.array(first % F.lit(SPLIT).cast("long"))
        parts = F.when(middle.isin(common), parts).otherwise(F.array(F.lit(0).cast("long")))
        return F.explode(F.transform(parts, lambda x: F.pmod(F.xxhash64(middle * F.lit(SPLIT).cast("long") + x), F.lit(shards)).cast("int"))).alias("shard")

    first = lambda c, bits: F.shiftright(c, bits)
    low = trusted.sparkSession.createDataFrame([(int(k), float(p2[k >> BITS, k & MASK])) for k in keys.tolist()], "low long, p2 double")
    full3 = own3.withColumn("low", tail(2 * BITS)).join(sums3, "context").join(low, "low").select("key", "context", ((F.col("own") / F.col("total")) + F.col("gamma") * F.col("p2")).alias("p3"))
    full4 = own4.withColumn("low", tail(3 * BITS)).join(sums4, "context").join(full3.select(F.col("key").alias("low"), "p3"), "low").select("key", ((F.col("own") / F.col("total")) + F.col("gamma") * F.col("p3")).alias("p4"))
    table = (
        full4.select(shard(pair("key", BITS), first("key", 3 * BITS)), F.lit(0).alias("kind"), "key", F.log("p4").alias("value"))
        .unionByName(sums4.select(shard(pair("context", 0), first("context", 2 * BITS)), F.lit(1).alias("kind"), F.col("context").alias("key"), F.log("gamma").alias("value")))
        .unionByName(full3.select(shard(pair("key", BITS), None), F.lit(2).alias("kind"), "key", F.log("p3").alias("value")))
        .unionByName(sums3.select(shard(pair("context", 0), None), F.lit(3).alias("kind"), F.col("context").alias("key"), F.log("gamma").alias("value")))
        .distinct()  # two shards of a common pair may be one
    )
    return Model(codes, np.log(np.maximum(p2, 1e-12)).astype(np.float32), table, shards, np.array(sorted(common), np.int64))


def _bytes_of(x: np.ndarray) -> bytes:
    """Byte plane by byte plane, which packs well."""
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _of_bytes(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def pack(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs sorted by key and document: differences of distinct keys, how many documents each has, differences of those, counts."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    step = np.diff(docs, prepend=0)
    step[first] = docs[first]
    parts = [_bytes_of(np.diff(keys[first], prepend=np.uint64(0))), _bytes_of(np.diff(np.append(first, len(keys))).astype(np.uint32)), _bytes_of(step.astype(np.uint32)), _bytes_of(counts.astype(np.uint32))]
    return zlib.compress(b"".join(len(p).to_bytes(4, "little") + p for p in parts), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys; for each pair, the number of its key, its document and its count."""
    data, at, parts = zlib.decompress(data), 0, []
    for kind in ("u8", "u4", "u4", "u4"):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(_of_bytes(data[at + 4 : at + 4 + size], kind))
        at += 4 + size
    keys, sizes = np.cumsum(parts[0], dtype=np.uint64), parts[1].astype(np.int64)
    which = np.repeat(np.arange(len(keys)), sizes)
    run = np.cumsum(parts[2].astype(np.int64))
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, run[first - 1], 0)
    return keys, which, run - before[which], parts[3].astype(np.int64)


def _values(keys: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], bigrams: np.ndarray) -> np.ndarray:
    """log P of the last character of each 4-gram."""

    def find(kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, values = tables[kind]
        if not len(have):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
        hit = have[at] == wanted
        return hit, np.where(hit, values[at], 0.0)

    keys = keys.astype(np.int64)
    hit4, p4 = find(0, keys)
    hit3, p3 = find(2, keys & ((1 << 3 * BITS) - 1))
    lowest = find(3, keys >> BITS & ((1 << 2 * BITS) - 1))[1] + bigrams[keys >> BITS & MASK, keys & MASK]
    return np.where(hit4, p4, find(1, keys >> BITS)[1] + np.where(hit3, p3, lowest))


def shards_of(keys: np.ndarray, common: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each sorted 4-gram, as train() has it: Spark's xxhash64 of the middle pair and the first character's part."""
    triples, which = np.unique(keys >> np.uint64(BITS), return_inverse=True)
    pairs = triples.astype(np.int64) & ((1 << 2 * BITS) - 1)
    parts = np.where(np.isin(pairs, common), (triples >> np.uint64(2 * BITS)).astype(np.int64) % SPLIT, 0)
    names, inverse = np.unique(pairs * SPLIT + parts, return_inverse=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(n.to_bytes(8, "little"), 42) for n in names.tolist()), np.uint64, len(names)).view(np.int64)
    return (hashes % shards)[inverse][which]


def log_probabilities(docs: DataFrame, model: Model) -> DataFrame:
    """Sums of log P by document (k1, k2), from documents given as (k1, k2, text); a document given twice counts twice."""
    arrow_limits(docs.sparkSession)
    codes, shards = model.codes, model.shards
    shared = docs.sparkSession.sparkContext.broadcast((codes, model.common, model.bigrams))  # bounded by the alphabet
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deals = max(1, -(-size // (shards * TASK_BYTES // 12)))

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, common, _ = shared.value
        for batch, texts in slices(batches):
            keys, docs, counts, _ = grams(texts, codes)
            own = shards_of(keys, common, shards)
            deal = int(batch.column(0)[0].as_py()) % deals
            k = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            rows = []
            for s in np.unique(own).tolist():
                at = np.flatnonzero(own == s)
                there, number = np.unique(docs[at], return_inverse=True)
                rows.append((s, pack(keys[at], number, counts[at]), k[:, there].tobytes()))
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] * deals + deal for r in rows], pa.int32()), pa.array([9] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array([0.0] * n, pa.float64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "key", "value", "pairs", "docs"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams = shared.value[2]
        now, held, tables = None, [], None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])) if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if shard[a] != now:
                    now, held, tables = shard[a], [], None
                if kind[a] < 9:
                    held.append((kind[a], batch.column(2).slice(a, b - a).to_numpy(), batch.column(3).slice(a, b - a).to_numpy()))
                    continue
                if tables is None:
                    tables = []
                    for wanted in range(4):
                        keys = np.concatenate([np.zeros(0, np.int64), *(k for x, k, _ in held if x == wanted)])
                        values = np.concatenate([np.zeros(0), *(v for x, _, v in held if x == wanted)])
                        order = np.argsort(keys)
                        tables.append((keys[order], values[order]))
                    held = []
                for i in range(a, b):
                    keys, which, doc, counts = unpack(batch.column(4)[i].as_py())
                    k = np.frombuffer(batch.column(5)[i].as_py(), np.int64).reshape(2, -1)
                    sums = np.bincount(doc, _values(keys, tables, bigrams)[which] * counts, k.shape[1])
                    n = np.bincount(doc, counts, k.shape[1]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k[0]), pa.array(k[1]), pa.array(sums), pa.array(n)], names=["k1", "k2", "log_p", "n"])

    asked = docs.select("k1", "k2", "text").mapInArrow(request, "shard int, kind int, key long, value double, pairs binary, docs binary")
    dealt = F.explode(F.sequence(F.col("shard") * deals, F.col("shard") * deals + (deals - 1))).alias("shard")
    table = model.table.select(dealt, "kind", "key", "value", F.lit(None).cast("binary").alias("pairs"), F.lit(None).cast("binary").alias("docs"))
    met = table.unionByName(asked).repartition(max(1, shards * deals), "shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(answer, "k1 long, k2 long, log_p double, n long").groupBy("k1", "k2").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, shards: int = 12, broadcast_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Per input row: the id, n_chars (after squeezing white space), log_p, perplexity (per character), threshold and keep.

    Trusted texts are those with label 1 (an id with several labels is trusted if any is 1). A fifth of them, by hash of the id, isn't
    trained on: the threshold is the `quantile` of these texts' perplexity in the same language; a language without any takes that of all,
    and if none are held out that of the trained texts. keep says whether the perplexity is at most the threshold.

    The trusted ids are broadcast up to `broadcast_ids` of them, counted first; beyond, they are joined by a shuffle. A null or
    empty text has no perplexity and isn't kept; a null language is a language of its own; a null id is never trusted; repeated
    rows give repeated results; without trusted text nothing has a threshold, and every text that isn't empty is kept; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.xxhash64(name, text).alias("k1"), F.xxhash64(text, name).alias("k2"), text.alias("text"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("held", held_for_thresholds("id"))
    trusted_ids = good.count()
    good = F.broadcast(good) if trusted_ids <= broadcast_ids else good
    model = train(rows.join(good.where("not held"), "id", "left_semi"), shards=shards)
    sums = log_probabilities(rows.select("k1", "k2", "text"), model)
    scored = checkpointed(rows.drop("text").join(sums, ["k1", "k2"], "left").withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n"))))
    trusted = scored.join(good, "id").where("perplexity is not null")
    cut = lambda held: F.percentile_approx(F.when(F.col("held") == held, F.col("perplexity")), F.lit(quantile), F.lit(10_000))
    limits = checkpointed(trusted.groupBy("lang").agg(cut(True).alias("own")))
    few = limits.count() <= 10_000  # languages
    every = trusted.agg(F.coalesce(cut(True), cut(False)).alias("every"))
    out = scored.join(F.broadcast(limits) if few else limits, "lang", "left").crossJoin(F.broadcast(every))  # one row
    threshold = F.coalesce("own", "every")
    copies = F.greatest(F.coalesce("copies", F.lit(1)), F.lit(1))
    twins = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    out = out.join(twins, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("n") / copies, F.lit(0)).cast("long").alias("n_chars"), (F.coalesce("log_p", F.lit(0.0)) / copies).alias("log_p"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= F.coalesce(threshold, "perplexity"), F.lit(False)).alias("keep"))


def held_for_thresholds(id_col: str) -> Column:
    """Whether a trusted text sets thresholds instead of being trained on: a fifth, by hash."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("thresholds")), F.lit(5)) == 0

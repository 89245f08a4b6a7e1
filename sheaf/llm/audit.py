"""Filter interaction audit: what each filter removes in each order of the filters, alone, together and in fair shares.

Exact copies are found by routing texts to partitions of an RDD by their 64-bit fingerprint. A partition keeps a collision chain for each
fingerprint: every different text in full, with the smallest id seen, so equal fingerprints of different texts stay apart. All other ids
come out as copies. Each document then is a mask of the filters that it fails, and vectors of counts by mask are merged by combineByKey;
all 120 orders are read off these vectors.

Texts move only if their fingerprint occurs again, and only once from each task and batch of texts (chains are built there first). A fingerprint of very many
rows is routed by a salt as well at first, so no partition receives it from every task.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sheaf.llm.common import arrow_limits, built, checkpointed, slices, token
from sheaf.llm.suffix import LEAST_BITS, MOST_BITS, empty_map, in_slot_map, slot_maps

FILTERS = "ABCDE"
COPY = 1 << 4
#: A fingerprint of more rows than this goes through SALTS partitions first.
HOT, SALTS = 10_000, 64
#: Texts that the chains of a map task hold before they are sent on, and what a partition of chains is meant to hold.
HELD_BYTES, PART_BYTES = 16 << 20, 32 << 20
_UPPER, _INNER, _MARKS = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0)), frozenset(b"#$%&*|")


def failed(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()
    points, upper = len(text.translate(None, _INNER)), len(text) - len(text.translate(None, _UPPER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | any(m in text for m in _MARKS) << 3


class Chains:
    """By fingerprint, the different texts with their smallest ids and how many rows of each language have that id."""

    def __init__(self) -> None:
        self.by: dict[int, list[list]] = {}
        self.held = 0

    def put(self, fp: int, text: bytes, mask: int, least, langs: dict[str, int]) -> Iterator[tuple]:
        """Keep an entry; rows (id, lang, mask, n) that it shows to be copies come out."""
        chain = self.by.setdefault(fp, [])
        for entry in chain:
            if entry[0] == text or zstandard.decompress(entry[0]) == zstandard.decompress(text):
                if least > entry[2]:
                    yield from ((least, lang, mask | COPY, n) for lang, n in langs.items())
                elif least < entry[2]:
                    yield from ((entry[2], lang, mask | COPY, n) for lang, n in entry[3].items())
                    entry[2:] = [least, dict(langs)]
                else:
                    for lang, n in langs.items():
                        entry[3][lang] = entry[3].get(lang, 0) + n
                return
        chain.append([text, mask, least, dict(langs)])
        self.held += len(text) + 300

    def entries(self) -> Iterator[tuple]:
        for fp, chain in self.by.items():
            for text, mask, least, langs in chain:
                yield fp, text, mask, least, langs


def documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, mask, n): the documents' failed filters as a mask, A the lowest bit; n equal rows may share one row."""
    spark = docs.sparkSession
    arrow_limits(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.xxhash64(text).alias("fp"), text.alias("text"))
    counts = checkpointed(given.where("id is not null").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"))
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * counts.count() + 1))))
    named = lambda name, least: counts.where(F.col("n") > least).select(F.lit(name).alias("name"), F.col("fp").alias("value"), F.lit(0).cast("long").alias("sent"))
    packed, _ = slot_maps(named("again", 1).union(named("hot", HOT)), bits)
    shared, key = spark.sparkContext.broadcast({"again": empty_map(bits), "hot": empty_map(bits)} | packed), token()
    kind = given.schema["id"].dataType

    def unpacked() -> dict[str, np.ndarray]:
        return {name: np.frombuffer(zlib.decompress(m), np.uint8) for name, m in shared.value.items()}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows (no text), and the chains' entries of texts whose fingerprint occurs again."""
        maps: dict[str, np.ndarray] = built(key, unpacked)  # type: ignore[assignment]
        packer, chains = zstandard.ZstdCompressor(3), Chains()
        types = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "lang", "mask", "n", "fp", "hot", "text"])

        def sent() -> list[tuple]:
            entries = list(chains.entries())
            hot = in_slot_map(maps["hot"], np.array([e[0] for e in entries], np.int64), bits).tolist() if entries else []
            return [(least, lang, mask, n, fp, h, text) for (fp, text, mask, least, langs), h in zip(entries, hot, strict=True) for lang, n in langs.items()]

        for batch, texts in slices(batches):
            types = types or [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            again = in_slot_map(maps["again"], batch.column(2).to_numpy(), bits).tolist()
            rows: list[tuple] = []
            for i, lang, fp, t, a in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), texts, again, strict=True):
                if a and i is not None:
                    rows += [(*row, None, None, None) for row in chains.put(fp, packer.compress(t), failed(t), i, {lang: 1})]
                else:
                    rows.append((i, lang, failed(t), 1, None, None, None))
            if chains.held > HELD_BYTES:
                rows += sent()
                chains = Chains()
            yield batch_of(rows)
        if chains.by:
            yield batch_of(sent())

    fields = [StructField("id", kind), StructField("lang", StringType()), StructField("mask", LongType()), StructField("n", LongType())]
    schema = StructType.fromDDL("fp long, hot boolean, text binary")
    found = checkpointed(given.mapInArrow(local, StructType([*fields, *schema.fields])))
    entries = found.where("text is not null")
    size = entries.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))

    def routed(rows, last: bool):
        """Entries by partition of their key; copies come out, and of each text the smallest id, at last as a finished row."""

        def chained(own: Iterator[tuple]) -> Iterator[tuple]:
            chains = Chains()
            for _, (fp, text, mask, least, langs) in own:
                for row in chains.put(fp, bytes(text), mask, least, langs):
                    yield None, row
            for entry in chains.entries():
                if last:
                    yield from ((None, (entry[3], lang, entry[2], n)) for lang, n in entry[4].items())
                else:
                    yield entry[0], entry

        return rows.partitionBy(parts, lambda k: k % parts).mapPartitions(chained, preservesPartitioning=False)

    def salted(part: int, rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            yield r["fp"] + (part % SALTS * 0x9E3779B97F4A7C15 if r["hot"] else 0), (r["fp"], r["text"], r["mask"], r["id"], {r["lang"]: r["n"]})

    plain, hot = entries.where("not hot").rdd.mapPartitionsWithIndex(salted), entries.where("hot").rdd.mapPartitionsWithIndex(salted)
    first = routed(hot, last=False)
    second = routed(plain.union(first.filter(lambda x: x[0] is not None)), last=True)
    done = first.filter(lambda x: x[0] is None).union(second).map(lambda x: x[1])
    return found.where("text is null").select("id", "lang", "mask", "n").unionByName(spark.createDataFrame(done, StructType(fields), verifySchema=False))


def steps(counts: np.ndarray) -> Iterator[tuple[str, int, list[int]]]:
    """All orders and steps of one part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. `counts` has a row
    for each mask and a column for each of neither, good, toxic, both."""
    masks, total = np.arange(32), counts.sum(1)
    good, toxic = counts[:, 1] + counts[:, 3], counts[:, 2] + counts[:, 3]
    out, shares = [], dict.fromkeys(FILTERS, 0)
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            fails, gone = masks & bit > 0, masks & before > 0
            removed = fails & ~gone
            before |= bit
            shares[f] += int(total[removed].sum())
            out.append(("".join(order), k + 1, [int(x) for x in (total[masks & before == 0].sum(), total[removed].sum(), total[fails & gone].sum(), total[bit], good[removed].sum(), toxic[removed].sum())], f))
    for order, step, numbers, f in out:
        yield order, step, [*numbers, shares[f]]


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each part (language; null: empty string), filter_order and step, with kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.

    A null text is empty (it fails A); equal texts are copies whatever their language; a null id is neither a copy nor anyone's smaller id; equal ids
    with equal texts are no copies of each other; labels are joined by id, several of one id count if one of them says so, and a document without
    labels is neither good nor toxic; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    marks = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = documents(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    marked = rows.join(marks, F.col("id") == F.col("label_id"), "left").select("lang", (F.col("mask") * 4 + F.expr("if(good, 1L, 0L) + if(toxic, 2L, 0L)")).alias("code"), "n")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            table = pa.table(batch.columns, names=["lang", "code", "n"]).group_by(["lang", "code"]).aggregate([("n", "sum")])
            for lang, code, n in zip(table["lang"].to_pylist(), table["code"].to_pylist(), table["n_sum"].to_pylist(), strict=True):
                found.setdefault(lang, np.zeros(128, np.int64))[code] += n
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    pairs = marked.mapInArrow(vectors, "lang string, counts array<long>").rdd.map(lambda r: (r["lang"], np.array(r["counts"], np.int64)))
    merged = pairs.combineByKey(lambda v: v, lambda a, b: a + b, lambda a, b: a + b)
    out = merged.flatMap(lambda x: [(x[0], order, step, *numbers) for order, step, numbers in steps(x[1].reshape(32, 4))])
    return spark.createDataFrame(out, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long", verifySchema=False)


#: The query over all documents, orders and steps.
AUDIT_SQL = """
with texts as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
marks as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
docs as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int m
  from texts left join marks using (doc_id)),
counts as (select part, m, count(*) n, count(*) filter (where good) g, count(*) filter (where toxic) x from docs group by part, m),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
orders as (
  select p.c || q.c || r.c || s.c || u.c filter_order, [p.b, q.b, r.b, s.b, u.b] bits
  from f p join f q on q.c <> p.c join f r on r.c not in (p.c, q.c) join f s on s.c not in (p.c, q.c, r.c) join f u on u.c not in (p.c, q.c, r.c, s.c)),
steps as (select filter_order, k::int step, bits[k] b, list_sum(bits[1 : k]) - bits[k] before from orders, unnest([1, 2, 3, 4, 5]) t(k)),
found as (
  select part, filter_order, step, b, sum(n) filter (where m & (before + b) = 0) kept, sum(n) filter (where m & b > 0 and m & before = 0) removed, sum(n) filter (where m & b > 0 and m & before > 0) redundant,
    sum(n) filter (where m = b) unique_fails, sum(g) filter (where m & b > 0 and m & before = 0) good_lost, sum(x) filter (where m & b > 0 and m & before = 0) toxic_lost
  from counts, steps group by part, filter_order, step, b)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
  coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, b))::bigint shapley
from found
"""

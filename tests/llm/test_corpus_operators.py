"""Operators over pairs and the whole corpus, against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import chat, common, quality, queries, simhash, suffix


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def fingerprint(text):
    words = (text or "").encode().translate(common.LOWER_TABLE).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs):
    base = docs.where("length(text) > 3000").orderBy("doc_id").first()["text"].split()
    rng = random.Random(2)
    near = []
    for k in range(80):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = f"edit{k}"
        near.append((1000 + k, " ".join(own)))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + near + [(5000, None), (5001, ""), (5002, " \n"), (None, None), (None, base[0]), (5003, "one two")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [fingerprint(t) for _, t in rows]
    x = np.array(prints, np.uint64)
    links = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4)]
    of = groups(len(x), links)
    least = {}
    for (i, _), g in zip(rows, of, strict=True):
        least[g] = min([v for v in (least.get(g), i) if v is not None], default=None)
    expected = sorted(str((i, f"{p:016x}", least[g])) for (i, _), p, g in zip(rows, prints, of, strict=True))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in out) == expected


def test_simhash_big_cell_and_bound():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    points = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(300)], np.uint64))
    of = groups(len(points), [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4)])
    at = {int(p): i for i, p in enumerate(points)}
    found = groups(len(points), [(at[a], at[b]) for a, b in simhash.link_cell(points, 4)])
    assert len(set(of)) == len(set(found))
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    assert (simhash.manhattan(simhash.bit_counts(a), simhash.bit_counts(b)) <= np.bitwise_count(a ^ b)).all()
    plain = [sum(abs(bin(int(x) >> s & 3).count("1") - bin(int(y) >> s & 3).count("1")) for s in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    assert simhash.manhattan(simhash.bit_counts(a), simhash.bit_counts(b)).tolist() == plain


def test_simhash_dense_cells(spark, monkeypatch):
    """Cells that are cut again and again give the same components."""
    monkeypatch.setattr(simhash, "DENSE_CELL", 60)
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 62, dtype=np.uint64)
    points = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False))) for _ in range(400)], np.uint64))
    of = groups(len(points), [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4)])
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    found = simhash.links(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")).collect()
    mine = groups(len(points), [(at[r["a"]], at[r["b"]]) for r in found])
    assert len({(a, b) for a, b in zip(of, mine, strict=True)}) == len(set(of)) == len(set(mine)) > 1


@pytest.mark.parametrize("n", [10, 30_000_000, 3_000_000_000])
def test_every_close_pair_shares_a_cell(n):
    rng = random.Random(n)
    masks = simhash.grid(n, 4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        x, y = (int(v) for v in simhash.bit_counts(np.array([a, b], np.uint64)))
        assert any((x ^ y) & (m % (1 << 64)) == 0 for m in masks)


def test_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 200) if i % 50] + [(300, 300)] + [(400, 400 + k) for k in range(1, 60)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(80)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    at = {v: i for i, v in enumerate(nodes)}
    of = groups(len(nodes), [(at[a], at[b]) for a, b in pairs if a != b])
    least = {}
    for v, g in zip(nodes, of, strict=True):
        least[g] = min(least.get(g, v), v)
    assert found == {v: least[g] for v, g in zip(nodes, of, strict=True)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def awkward_texts():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    out = ["a" * 2000, None, "", base[:300], base[:420], base[5:425], "x" + base[:700] + "y" + base[300:900], "ab" * 500 + base[1000:1401] + "z", base[1000:1500] + "q", base[1000:1500] + "q"]
    for _ in range(40):
        a, n = rng.randrange(2500), rng.choice([300, 340, 370, 380, 399, 400, 410, 500])
        out.append("".join(rng.choice("uvw") for _ in range(rng.randrange(50))) + base[a : a + n] + "".join(rng.choice("rst") for _ in range(rng.randrange(50))))
    return out


def test_suffix_dedup(spark, docs):
    rows = [(i, t) for i, t in enumerate(awkward_texts())] + [(1000 + r["doc_id"], r["text"]) for r in docs.limit(80).collect()] + [(None, "k" * 400), (None, "k" * 400), (3, "k" * 401)]
    out = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in out.collect())
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), t, gone in zip(rows, texts, suffix.brute(texts, 400), strict=True):
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append(str((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())))
    assert found == sorted(expected)
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree_merges_and_counts_prefixes():
    rng = random.Random(9)
    words = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(500))
    runs = [[] for _ in range(7)]
    for w in words:
        runs[rng.randrange(6)].append((w, b"", b"p"))  # one run stays empty
    tree = suffix.LoserTree([suffix.read_run(suffix.pack_run(r)) for r in runs])
    out = list(tree)
    assert [e[1] for e in out] == words
    assert [e[0] for e in out[1:]] == [suffix.common(a, b) for a, b in zip(words[:-1], words[1:], strict=True)]
    assert list(suffix.LoserTree([])) == []


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "a"), (4, 1, "bot", "c"), (5, 0, "user", None), (6, 0, "user", ""), (7, 5, "user", "a"), (7, 9, "bot", "b"), (7, 9, "bot", "b"),
        (8, None, None, None), (None, 0, "user", "a"), (9, 0, "user", "a|1:b"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.maximal_conversations(turns).collect()}
    assert found == {2: (2, 3), 4: (2, 1), 5: (1, 1), 6: (1, 1), 8: (1, 1), 9: (1, 1)}
    con = duckdb.connect()
    con.register("conversations", turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    theirs = {r[0]: (r[1], r[2], r[3]) for r in con.execute("select conv_id, n_turns, n_copies, rendered from (" + chat.MAXIMAL_SQL + ")").fetchall()}
    assert {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.maximal_conversations(turns).collect()} == theirs
    assert chat.maximal_conversations(turns.where("false")).count() == 0


def kneser_ney(texts, codes):
    """The same model from its definition, with dictionaries."""
    keyed = []
    for t in texts:
        x = [1] * 3 + [int(c) for c in codes[quality.units((t or "").encode())]]
        keyed += [tuple(x[i : i + 4]) for i in range(len(x) - 3)]
    four = {}
    for k in keyed:
        four[k] = four.get(k, 0) + 1
    levels = [four]
    for _ in range(2):
        low = {}
        for k in levels[-1]:
            low[k[1:]] = low.get(k[1:], 0) + 1
        levels.append(low)
    one = {}
    for k in levels[-1]:
        one[k[1:]] = one.get(k[1:], 0) + 1
    size = 1 << quality.BITS
    total = sum(one.values()) + 0.5 * size
    tables = []
    for level in levels:
        d = quality.discounts(*[sum(v == n for v in level.values()) for n in (1, 2, 3, 4)])
        context = {}
        for k, v in level.items():
            c = context.setdefault(k[:-1], [0, 0.0])
            c[0] += v
            c[1] += d[min(v, 3) - 1]
        tables.append((level, context, d))

    def p(k, depth=0):
        if depth == 3:
            return (one.get(k, 0) + 0.5) / total
        level, context, d = tables[depth]
        lower = p(k[1:], depth + 1)
        if k[:-1] not in context:
            return lower
        n, held = context[k[:-1]]
        v = level.get(k, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / n + held / n * lower

    return p


def test_perplexity_is_the_models(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.where("length(text) < 2500")
    extra = spark.createDataFrame([(90001, None, None), (90002, "", "en"), (90003, "same \n again", "xx"), (90003, "same \n again", "xx"), (None, "no id \U0001f600", None)], "doc_id long, text string, lang string")
    every = some.select("doc_id", "text", "lang").unionByName(extra)
    out = quality.classify(every, labels, shards=3).collect()
    assert len(out) == every.count()
    good = {r["doc_id"] for r in labels.where("quality = 1").where(~quality.held_for_thresholds("doc_id")).collect()}
    texts = [r["text"] for r in some.collect() if r["doc_id"] in good]
    codes = quality.alphabet(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney(texts, codes)
    by = {r["doc_id"]: r["text"] for r in every.collect()}
    for r in out:
        x = [1] * 3 + [int(c) for c in codes[quality.units((by[r["doc_id"]] or "").encode())]]
        log = sum(math.log(p(tuple(x[i : i + 4]))) for i in range(len(x) - 3))
        assert r["n_chars"] == len(x) - 3 and r["log_p"] == pytest.approx(log, rel=1e-4, abs=1e-6)
        assert (r["perplexity"] is None) == (len(x) == 3) and (len(x) > 3 or not r["keep"])


def test_model_sums_to_one(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    codes = quality.alphabet(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney(texts, codes)
    assert sum(p((5, 6, 7, c)) for c in range(1 << quality.BITS)) == pytest.approx(1)


def test_quality_without_trust(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").limit(10), spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.classify(docs, labels.where("false")).where("keep").count() == docs.where("text <> ''").count()


def test_quality_tells_junk(spark):
    """On labelled texts that the classifier never saw: neither trained on nor used for thresholds."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 3
    out = quality.classify(docs, labels.where(~unseen)).join(labels.where(unseen), "doc_id")
    rate = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.4


def test_shards_split_common_pairs_and_requests(spark, sf, monkeypatch):
    """One shard or many, requests dealt or not: the same perplexities."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500"), spark.read.parquet(f"{sf}/labels.parquet")
    results = []
    for shards, bytes_ in ((1, 1 << 30), (5, 1 << 30), (3, 1 << 16)):
        monkeypatch.setattr(quality, "TASK_BYTES", bytes_)
        results.append({r["doc_id"]: r["log_p"] for r in quality.classify(docs, labels, shards=shards).collect()})
    for other in results[1:]:
        assert other == pytest.approx(results[0], rel=1e-9)


def test_quality_of_texts_beyond_the_alphabet(spark):
    """Characters without codes of their own don't all look alike."""
    rng = random.Random(4)
    own = [chr(0x4E00 + rng.randrange(3000)) for _ in range(200)]
    rows = [(i, "".join(rng.choice(own) for _ in range(300)), "zh") for i in range(20)] + [(100, "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(300)), "zh")]
    out = {r["doc_id"]: r["perplexity"] for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")).collect()}
    assert out[100] > 1.2 * max(v for k, v in out.items() if k < 100)

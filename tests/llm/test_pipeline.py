"""The pipeline stage by stage: what each keeps, against brute force on a small table."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import bpe, langid, suffix


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(9001 as bigint) doc_id", "'12 34 !!' text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("cast(9002 as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    frames, now = [("input", docs.unionByName(extra.select(docs.columns)))], docs.unionByName(extra.select(docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        frames.append((name, now))
    return dict(frames)


def test_columns(stages):
    for name in ("language", "near_duplicates", "repeated_passages", "benchmark"):
        assert sorted(stages[name].dtypes) == sorted(stages["input"].dtypes)


def test_language_keeps_clean(stages):
    gone = stages["input"].join(stages["language"], "doc_id", "left_anti")
    assert {9001, 9002} <= {r["doc_id"] for r in gone.collect()} and gone.count() <= 6


def test_one_of_each_group(stages):
    before, after = stages["language"], stages["near_duplicates"]
    copies = before.groupBy("text").count().where("count > 1")
    assert copies.count() > 0 and after.groupBy("text").count().where("count > 1").count() == 0
    assert after.select("text").distinct().count() >= 0.95 * before.select("text").distinct().count()


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text), (5, text), (4, text), (4, text), (None, other), (None, other), (4, "a third text of its own kind here"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(4, text), (None, other), (4, "a third text of its own kind here"), (7, None)], key=str)
    assert kept.columns == docs.columns


def test_passages_are_cut(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["repeated_passages"].collect()}
    texts = [t.encode() for t in before.values()]
    for (i, t), gone in zip(before.items(), suffix.brute(texts, 400), strict=True):
        left = bytes(c for c, g in zip(t.encode(), gone, strict=True) if not g).decode("utf-8", "ignore")
        assert after[i] == (left, len(left))


def test_contaminated_go(stages):
    assert 0 < stages["benchmark"].count() <= stages["repeated_passages"].count()


def test_ids(stages):
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = {r["doc_id"]: r for r in stages["token_ids"].collect()}
    for r in stages["benchmark"].limit(30).collect():
        ids = codec.encode([r["text"]])[0]
        assert out[r["doc_id"]]["ids_sha256"] == hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def test_run_is_the_stages(spark, stages):
    clean = stages["token_ids"].where("doc_id < 9000").select("doc_id", "ids_sha256", "decoded_sha256")
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select(clean.columns)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, clean.collect()))


CLASHING = ["row key", "row_key", "Row_Check", "row", "a.b", "back`tick", "kept", "component", "least", "lang_pred", "score", "spans", "contaminated"]


def staged(spark, docs, folder, sf, upto=5):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:upto]):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def test_clashing_names_pass_through(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    clashing = plain.select("*", *[F.concat(F.lit("mine "), "doc_id").alias(c) for c in CLASHING])
    kept = staged(spark, clashing, tmp_path / "c", sf, 4)
    assert kept.columns == clashing.columns and kept.count() > 100
    assert all(r[c] == f"mine {r['doc_id']}" for r in kept.collect() for c in CLASHING)
    expected = staged(spark, plain, tmp_path / "p", sf, 4)
    assert sorted(map(str, kept.select(plain.columns).collect())) == sorted(map(str, expected.collect()))


def test_awkward_texts_and_empty_tables(spark, tmp_path):
    """Null, empty, very long and repeated texts; then no documents, and no benchmark."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.where("lang = 'en'").select(F.concat_ws(" ", F.collect_list("text"))).first()[0]
    rows = [(9000, " ".join([long] * (150_000 // len(long.split()) + 1)), "en", "s", 1), (9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "12 !", "en", None, 4), (None, long[:3000], "en", "s", 3000), (None, long[:3000], "en", "s", 3000)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = {r["doc_id"]: r for r in staged(spark, both, tmp_path / "a", sf).collect()}
    assert not {9001, 9002, 9003} & set(out) and len(out) > 100
    empty = tmp_path / "sf"
    spark.read.parquet(f"{sf}/benchmark.parquet").where("false").write.parquet(str(empty / "benchmark.parquet"))
    assert staged(spark, docs.where("false"), tmp_path / "e", str(empty)).count() == 0
    assert corpus_pipeline.benchmark(spark, docs, str(empty)).count() == docs.count()


def test_language_and_benchmark_against_plain_rules(stages, spark):
    """What the two filters keep is what their operators' own rows say, and the benchmark's is the contract's rule by plain Python."""
    before, after = stages["repeated_passages"].collect(), {r["doc_id"] for r in stages["benchmark"].collect()}
    lower, words = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: words.findall((t or "").translate(lower))
    items = [w for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect() if (w := split(r["text"]))]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12))}
    kept = set()
    for r in before:
        w, hit = split(r["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(r["doc_id"])
    assert after == kept
    gone = {r["doc_id"]: r for r in stages["input"].join(stages["language"], "doc_id", "left_anti").collect()}
    letters = {i for i, r in gone.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    predicted = langid.predict(stages["input"], langid.train(stages["input"].where(~langid.held_out(4, 2)))).collect()
    assert set(gone) == {r["doc_id"] for r in predicted if r["lang_pred"] == "und" or r["score"] < 0.5} and len(letters) <= 4

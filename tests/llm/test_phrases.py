"""Phrase collocations against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, top=2000, most=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string").repartition(3)


def found(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


@pytest.mark.parametrize("bits", [20, 9])
def test_against_brute_force(spark, monkeypatch, bits):
    """With few slots nearly all n-grams pass the sketches."""
    monkeypatch.setattr(phrases, "LEAST_BITS", bits)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rng = random.Random(5)
    words = ["The", "cat", "sat", "é", "on", "mat x", "Ä"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", " \t", ". ", "\n", "\x0b", "; "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None])) for _ in range(60)]
    docs += [("New York City is big. " * 3, "en")] * 15 + [(None, "en"), ("", "de"), ("... !", None), ("rare words here", "de")]
    assert found(frame(spark, docs), least=6, top=50) == brute(docs, 6, 50)
    assert found(frame(spark, docs)) == brute(docs)


def test_one_long_piece(spark):
    text = "a b c " * 20_000
    assert found(frame(spark, [(text, "en"), ("x", "en")])) == brute([(text, "en"), ("x", "en")])


def test_empty_and_clashing(spark):
    df = frame(spark, [("a b " * 40, "en")])
    assert found(df.where("false")) == []
    plain = found(df)
    assert plain and found(df.selectExpr("*", "1 n", "2 piece", "3 gram", "4 rank", "5 phrase", "6 `a.b`")) == plain


def test_products_beyond_64_bits(spark):
    a = 6 * 10**12  # 2,000,000 times this passes 2**63
    known = spark.createDataFrame([("en", "x", a + 1), ("en", "y", a + 7), ("en", "x y", a)], "lang string, gram string, a long")
    row = phrases.best_cuts(known.where("gram = 'x y'").select("lang", F.col("gram").alias("phrase"), "a", F.split("gram", " ").alias("words")), known).first()
    assert row["cut"]["score"] == 2000000 * a // (2 * a + 8) == 999999


def test_sums_leave_nothing_behind(tmp_path, monkeypatch):
    monkeypatch.setattr(phrases.tempfile, "tempdir", str(tmp_path))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 3], pa.int64()), pa.array(["a", "a", "b"]), pa.array(["x", "x", "x"]), pa.array([2, 3, 1], pa.int64())], names=["bucket", "lang", "gram", "n"])
    out = [r for b in phrases.summed(iter([batch, batch]), 3) for r in b.to_pylist()]
    assert out == [{"bucket": 7, "lang": "a", "gram": "x", "n": 10}] and not list(tmp_path.iterdir())

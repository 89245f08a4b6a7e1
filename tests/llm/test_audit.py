"""The filter audit against plain Python."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest
import zstandard

from sheaf.llm import audit


def brute(docs, labels):
    """docs: (id, text, lang) rows; labels: (id, quality, toxic) rows."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > least[t]}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out, shares = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shares[part, f] += len(gone)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone))
    return {(p, o, k): (*v, shares[p, o[k - 1]]) for (p, o, k), v in out.items()}


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check(spark, docs, labels):
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(*tables(spark, docs, labels)).collect()}
    assert found == brute(docs, labels)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(audit, "HOT", hot)
    rng = random.Random(hot)
    texts = [" ".join(rng.choices(["Ab", "cd", "é", "XY", "#1", *map(str, range(k))], k=rng.choice([3, 99, 100, 130]))) for k in rng.choices([10, 500], k=25)] + ["", "A", "AB" + "é" * 18]
    docs = [(rng.randrange(200), rng.choice(texts), rng.choice(["en", "fr", "", None])) for _ in range(150)]
    docs += [(None, texts[0], "en"), (None, None, None), (5, None, "fr"), (4, "", "en"), *[(7, texts[1], "en")] * 3, *[(6, texts[1], "de")] * 2]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    check(spark, docs, labels)


def test_no_labels_and_empty(spark):
    check(spark, [(1, "a", "en"), (2, "a", "fr")], [])
    docs, labels = tables(spark, [(1, "a", "en")], [(1, 1, 1)])
    assert audit.audit(docs.where("false"), labels).count() == 0


def test_clashing_columns(spark):
    docs, labels = tables(spark, [(1, "a", "en"), (2, "a", "fr")], [(1, 1, 0)])
    plain = sorted(map(str, audit.audit(docs, labels).collect()))
    assert sorted(map(str, audit.audit(docs.selectExpr("*", "'x' id", "'x' fp", "1 mask", "2 n", "3 hot", "4 code", "5 good", "6 label_id", "7 `a.b`"), labels.selectExpr("*", "8 id", "9 lang", "1 text")).collect())) == plain


def test_chains_keep_texts_of_one_fingerprint_apart():
    pack = zstandard.compress
    chains, out = audit.Chains(), []
    for text, i, lang in [(b"x", 3, "a"), (b"y", 2, "b"), (b"x", 1, "b"), (b"y", 2, "a"), (b"x", 9, "c")]:
        out += list(chains.put(77, pack(text), 0, i, {lang: 1}))
    assert out == [(3, "a", audit.COPY, 1), (9, "c", audit.COPY, 1)]
    assert [(zstandard.decompress(t), least, langs) for _, t, _, least, langs in chains.entries()] == [(b"x", 1, {"b": 1}), (b"y", 2, {"b": 1, "a": 1})]
    assert list(chains.put(77, zstandard.compress(b"y" * 1, 19), 0, 5, {"d": 2})) == [(5, "d", audit.COPY, 2)]

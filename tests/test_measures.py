"""Counts of text metrics against plain patterns, a text at a time."""

from __future__ import annotations

import random
import re

from sheaf.operators import measures, quality

SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
EDGES = re.escape(measures.EDGES)
LIMITS = {"line_tokens": 4, "vowelless": 0.30, "symbol": 0.15, "case_switch": 0.10, "devanagari": 0.01, "latin": 0.35}
SIGNS = list("aeibcdfgAEBC 012.,;:!?()[]{}\"'`—–- \n\r\t\x0b\x0c\x1c\x1e\x85\xa0 　​éßÜñनमते$%@|/«\x00\x7f�")
WORDS = ["the", "THE", "Which", "whiche", "bcd", "BCDF", "aBc", "a-b", "a.b.", "..a/b..", "ljQLo", "k|fKt", "x", "(a)", "a)b", "--", "ab'c", "tion.", "\r\n", "\n", "\r"]


def odd_tokens(tokens):
    word = r"(?:[^\W_]|[ऀ-ःऺ-ॏ])"
    symbolic = re.compile(rf"[{EDGES}]*+[^{EDGES}](?:{word})*+(?!{word}).(?:.*[^{EDGES}].*)", re.DOTALL)
    return {
        "alpha": sum(bool(re.fullmatch("[A-Za-z]{3,}", t)) for t in tokens), "vowelless": sum(bool(re.fullmatch("(?i:[b-df-hj-np-tv-z]{3,})", t, re.ASCII)) for t in tokens),
        "symbolic": sum(bool(symbolic.fullmatch(t)) for t in tokens), "switched": sum(any(a.islower() and b.isupper() for a, b in zip(t, t[1:])) for t in tokens),
    }


def plain(text):
    lines = re.split("[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", text.replace("\r\n", "\n"))
    lines = lines[:-1] if lines[-1] == "" else lines
    split = lambda t: re.findall(f"[^{SPACE}]+", t)
    tokens, judged, legacy = split(text), 0, 0
    for line in lines:
        words = split(line)
        if len(words) >= 4:
            o, solid = odd_tokens(words), "".join(words)
            shape = o["vowelless"] > 0.30 * o["alpha"] or o["symbolic"] / len(words) > 0.15 or o["switched"] / len(words) > 0.10
            foreign = len(re.findall("[ऀ-ॿ]", solid)) > 0.01 * len(solid) or len(re.findall("[A-Za-z]", solid)) < 0.35 * len(solid)
            judged, legacy = judged + 1, legacy + (shape and not foreign)
    return odd_tokens(tokens) | {
        "chars": len(text), "total": len("".join(tokens)), "tokens": len(tokens), "lines": len(lines), "filled": sum(bool(split(x)) for x in lines), "latin": len(re.findall("[A-Za-z]", text)),
        "stopwords": sum(t.lower() in quality.STOPWORDS for t in tokens), "judged": judged, "legacy": legacy, "replacement": text.count("�"), "control": len(re.findall(r"[\x00-\x08\x0e-\x1f]", text)),
    }


def test_counts_are_those_of_plain_patterns():
    r = random.Random(3)
    texts = ["", "\r\n", "\n", "a", "a\r", "\n", "a\r\n\r\nb", "....", "a.", ""]
    texts += ["".join(r.choice(SIGNS) for _ in range(r.randrange(1, 90))) for _ in range(1500)] + [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 40))) for _ in range(1500)]
    found = measures.measure(texts, quality.STOPWORDS, **LIMITS)
    assert set(found) == set(measures.COUNTS)
    for i, text in enumerate(texts):
        expected = plain(text)
        assert {k: int(found[k][i]) for k in expected} == expected, repr(text)
    alone = [measures.measure([t], quality.STOPWORDS, **LIMITS) for t in texts[:300]]
    assert all(int(a[c][0]) == int(found[c][i]) for i, a in enumerate(alone) for c in measures.COUNTS)


def test_a_text_is_read_once(spark):
    """No pattern goes over a text again; other columns, null texts and repeated rows pass through."""
    rows = spark.createDataFrame([(1, None, [1.5]), (2, "the aBc\r\nx", None), (2, "the aBc\r\nx", None)], "k int, text string, more array<double>")
    out = quality.text_metrics(rows)
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("mapinarrow") == 1 and "regexp" not in plan
    assert out.columns == ["k", "text", "more", "metrics"]
    got = sorted((r["k"], r["text"], r["more"], r["metrics"]["token_count"], r["metrics"]["line_count"], r["metrics"]["intraword_case_switch_ratio"]) for r in out.collect())
    assert got == [(1, None, [1.5], 0, 0, 0.0), (2, "the aBc\r\nx", None, 3, 2, 0.3333), (2, "the aBc\r\nx", None, 3, 2, 0.3333)]


def test_verdicts_read_a_text_once(spark, sf):
    """The verdicts' plan has no pattern over whole texts, and every row of the table its verdict."""
    from sheaf.plans import documents

    out = documents.text_verdicts(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("mapinarrow") == 1 and "regexp" not in plan
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()

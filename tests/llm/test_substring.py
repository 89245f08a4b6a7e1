"""Substring dedup against a table of all windows."""

from __future__ import annotations

import random

import pytest

from sheaf.llm import substring, suffix


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def check(spark, texts, length):
    out = {r["doc_id"]: r for r in substring.dedup(frame(spark, list(enumerate(texts))), length=length).collect()}
    for i, (t, gone) in enumerate(zip(texts, substring.brute([(t or "").encode() for t in texts], length), strict=True)):
        words = (t or "").encode().split()
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        assert (out[i]["kept"], out[i]["n_words"], out[i]["n_removed"]) == (kept, len(words), sum(gone)), (i, length)
        assert sum(s["end"] - s["start"] for s in out[i]["spans"]) == sum(gone)


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 35])
def test_random_texts(spark, length):
    rng = random.Random(length)
    vocabulary = [f"w{i}" for i in range(3 if length < 35 else 40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 6 * length))) for _ in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=length + 3))
    texts += [f"{a} {passage}\t{b}" for a, b in zip(texts[:8], texts[8:16], strict=True)] + [passage, passage, passage + " x", "", None, "\x0b \n", texts[0], texts[0]]
    check(spark, texts, length)


def test_blocks_and_pieces(spark, monkeypatch):
    """Windows that lie across the cuts of long texts; the workers hash with the small sizes too where they are forked after the change, so the arrays are tried here."""
    rng = random.Random(7)
    text = " ".join(rng.choices("abcd", k=3000)).encode()
    whole = substring.word_hashes(text)
    plain = substring.windows(whole, substring.np.array([0]), substring.np.array([len(whole) - 9]), 9)
    monkeypatch.setattr(substring, "BLOCK", 50)
    monkeypatch.setattr(substring, "PIECE_BYTES", 100)
    assert (substring.word_hashes(text) == whole).all()
    found = substring.segments(whole, 9, lambda g: substring.np.ones(len(g), bool))
    starts = sorted(x for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True) for x in range(a, b + 1))
    assert starts == list(range(len(whole) - 8))
    assert all((a == b).all() for a, b in zip(substring.windows(whole, substring.np.array([0]), substring.np.array([len(whole) - 9]), 9), plain, strict=True))


def test_equal_windows_have_equal_keys():
    """The half-length window of a segment depends on the words of each of its windows alone."""
    rng = random.Random(3)
    words = [b" ".join(x.encode() for x in rng.choices("ab", k=400)) for _ in range(4)]
    by_window: dict[bytes, set[int]] = {}
    for t in words:
        found = substring.segments(substring.word_hashes(t), 12, lambda g: substring.np.ones(len(g), bool))
        w = t.split()
        for key, a, b in zip(found.key.tolist(), found.first.tolist(), found.last.tolist(), strict=True):
            for x in range(a, b + 1):
                by_window.setdefault(b" ".join(w[x : x + 12]), set()).add(key)
    assert all(len(keys) == 1 for keys in by_window.values())


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    """With one bit for everything all candidates go through to the exact counts."""
    monkeypatch.setattr(substring, "LEAST_BITS", 2)
    monkeypatch.setattr(substring, "MOST_BITS", 2)
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(30)]
    texts += [texts[0], texts[1] + " z", "z " + texts[2], texts[3][:40] + texts[4][:60]]
    check(spark, texts, 6)


def test_repeated_rows_null_ids_and_carried_columns(spark):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text + " more", "b"), (2, None, None)], "doc_id long, text string, `a.b` string")
    out = substring.dedup(docs, carry=True)
    rows = sorted(((r["doc_id"], r["kept"], r["row"]["a.b"]) for r in out.collect()), key=str)
    assert rows == sorted([(1, "", "a"), (1, "", "a"), (None, "more", "b"), (2, "", None)], key=str)
    assert substring.dedup(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        substring.dedup(docs, length=0)


def test_a_worker_unpacks_the_bitmaps_it_asks_for():
    """The last step of a job needs two of the five bitmaps, of up to 32 MB each, and the workers of an executor hold theirs at once."""
    levels = substring.Levels({name: suffix.empty_map(20) for name in substring.Levels.NAMES}, 20)
    assert not levels.maps
    hashes = substring.word_hashes(b" ".join(b"w%d" % (i % 50) for i in range(200)))
    levels.segments(hashes, substring.np.array([0, 200]), 35)
    assert set(levels.maps) <= {"anchors", "alone"}
    maps = suffix.Maps({name: suffix.empty_map(20) for name in suffix.Maps.NAMES}, 20)
    maps.halves(b"0123456789" * 100, 400, 48)
    assert set(maps.maps) <= {"grams", "alone"}


def test_texts_beside_others_have_the_segments_they_have_alone(monkeypatch):
    """Whatever texts share a pass of numpy: longer ones than a block, empty ones, and copies."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghij", k=n)).encode() for n in (400, 0, 11, 12, 13, 30, 99, 100, 101, 1, 0, 250, 60, 40)]
    texts += [texts[0], b"", texts[5]]
    monkeypatch.setattr(substring, "BLOCK", 100)
    every = lambda g: substring.np.ones(len(g), bool)
    for order in (texts, texts[::-1], texts[3:]):
        found = []
        for hashes, bounds, begin, _ in substring.together(order):
            s = substring.segments(hashes, 12, every, substring.within(bounds, 12))
            doc = substring.np.searchsorted(bounds, s.first, "right") - 1
            found += zip((begin + doc).tolist(), s.key.tolist(), s.digest.tolist(), (s.first - bounds[doc]).tolist(), (s.last - bounds[doc]).tolist(), strict=True)
        alone = [(i, *row) for i, t in enumerate(order) for s in [substring.segments(substring.word_hashes(t), 12, every)] for row in zip(s.key.tolist(), s.digest.tolist(), s.first.tolist(), s.last.tolist(), strict=True)]
        assert sorted(found) == sorted(alone) and len(found) > 20

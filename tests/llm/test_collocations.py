"""Phrase collocations against plain counting, and the prefix-free parse by itself."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from feedback_engine.llm import collocations as C
from feedback_engine.llm.common import ship_code


def pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def brute_force(rows, most_words=3, least=10, share=50, first=2000):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        for words in pieces(text):
            own = counts.setdefault(lang if lang is not None else "und", Counter())
            for m in range(1, most_words + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(k for p, k in f.items() if len(p) == 1)
        candidates = {p: k for p, k in f.items() if len(p) > 1 and k >= least}
        found = []
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            ):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Few words, so that phrases repeat; copies, odd signs, null and blank languages and texts, a very long piece."""
    dice, out = random.Random(11), []
    words = ["the", "THE", "of", "é", "Œuf", "KelvinK", "a-b", "x y", "12", "и", "%", "der"]
    seps = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b", "\r\n", " ;", "? !"]
    for i in range(260):
        text = "".join(dice.choice(words) + dice.choice(seps[:3] * 4 + seps) for _ in range(dice.randrange(0, 60)))
        out += [(dice.choice(["en", "en", "en", "de", None, "und", ""]), text)] * dice.choice([1, 1, 1, 5])
    out += [("en", None), (None, ""), ("de", " \t\n"), ("fr", "one two " * 12), ("long", "w " * 30_000), ("long", "p q r s t " * 4_000)]
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"most_words": 2, "least": 3, "share": 80}, {"most_words": 4, "least": 5, "first": 7}])
def test_against_brute_force(spark, rows, options):
    ship_code(spark)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, N int, KEY string").repartition(5)
    assert found(C.collocations(docs, **options)) == brute_force(rows, **options)


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert C.collocations(docs.where("false")).count() == 0
    assert C.collocations(docs.where("text = ''")).count() == 0


@pytest.mark.parametrize("trigger", [1, 2, 8, 10**9])
@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_every_gram_belongs_to_one_chunk(rows, trigger, overlap):
    """N-grams counted inside chunks, overlaps once, are the n-grams of the pieces."""
    for _, text in rows[:60]:
        data = C._single_blanks((text or "").encode().lower().translate(C._ENDS) + b"\n")
        direct, parsed = Counter(), Counter()
        for words in pieces(text):
            for m in range(1, overlap + 2):
                direct.update(" ".join(words[i : i + m]) for i in range(len(words) - m + 1))
        for key in C.parse(data, overlap, trigger):
            words, tail = key.decode()[:-1].split(" "), key.endswith(b"\n")
            owned = len(words) if tail else len(words) - overlap
            for m in range(1, overlap + 2):
                parsed.update(" ".join(words[i : i + m]) for i in range(owned) if i + m <= len(words))
        assert parsed == direct


def test_counts_do_not_depend_on_the_filter(spark, rows, monkeypatch):
    """A filter that lets everything through gives the same result."""
    ship_code(spark)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = found(C.collocations(docs))
    monkeypatch.setattr(C, "phrase_filter", lambda hashes, n: np.array([(1 << 64) - 1], np.uint64))
    assert found(C.collocations(docs)) == want


def test_best_rows_in_many_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "SPREAD", 2)
    df = spark.range(5_000).selectExpr("if(id % 3 = 0, 'b', 'a') g", "id % 97 s", "id i")
    best = C.best_rows(df, "g", [C.F.desc("s"), C.F.asc("i")], 20).collect()
    for g in "ab":
        own = sorted((-(i % 97), i) for i in range(5_000) if (i % 3 == 0) == (g == "b"))[:20]
        assert [i for _, i in own] == [r["i"] for r in sorted((r for r in best if r["g"] == g), key=lambda r: r["rank"])]

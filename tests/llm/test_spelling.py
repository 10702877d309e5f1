"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from surfaudit.llm import spelling
from surfaudit.llm.common import table
from surfaudit.llm.spelling import spelling_variants
from tests.llm.test_operators import SF

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n, near = brute_words(rows), defaultdict(set)
    by_hole = defaultdict(list)  # words that agree once one letter, or a gap, is left out
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i] + w[i + 1 :]].append(w)
        by_hole[w].append(w)
    for held in map(set, by_hole.values()):
        for a in held:
            near[a].update(b for b in held if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    root = {}
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        root[w] = end
    return sorted((w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in spelling_variants(df).collect())


@pytest.mark.parametrize("cell", [512, 2])
def test_supplied_documents(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "BLOCK", 64 if cell == 2 else spelling.BLOCK)
    df = table(spark, SF, "documents")
    want = brute_variants([(r.doc_id, r.text) for r in df.collect()])
    assert found(df) == want and any(r[4] for r in want)


def test_variants_of_frequent_words(spark):
    draw = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzàé×ÿ"
    rows = []
    for i in range(300):
        words = []
        for base, times in (("separate", 9), ("necessary", 4), ("séparément", 3), ("aaaaaaaaaa", 2), ("product" + "x" * 8, 2)):
            words += [base] * times
            at, c = draw.randrange(len(base) + 1), draw.choice(letters)
            words += [base[:at] + c + base[at:], base[:at] + c + base[at + 1 :], base[:at] + base[at + 1 :]] if i % 3 == 0 else []
        words += ["product" + "".join(draw.choice("ab") for _ in range(8))]
        draw.shuffle(words)
        rows.append((i if i % 7 else None, draw.choice([" ", "-", "Ā", "9"]).join(words)))
    rows += [(1, None), (2, ""), (3, "×÷ÀßÿþÀ " * 3), (4, "Z" * 30 + " " + "z" * 30), (5, "z" * 31 + " " + "z" * 31), (5, "z" * 31)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "len": F.lit(2)})
    want = brute_variants(rows)
    assert found(df) == want
    assert any(r[1] for r in want)


def test_very_long_words(spark):
    rows = [(i, " ".join(["z" * 40_000, "z" * 40_001, "zy" * 20_000])) for i in range(2)]
    words = brute_words(rows)
    got = {r.word: (r.n, r.n_near) for r in spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {w: (n, sum(abs(len(w) - len(v)) == 1 and w[0] == v[0] and "y" not in w + v for v in words)) for w, n in words.items()}


def test_empty_tables(spark, no_docs):
    assert spelling_variants(no_docs).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 0

"""Near copies of the pipeline against all pairs of word-shingle sets."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline
from surfaudit.llm import near_copies
from surfaudit.llm.common import table
from surfaudit.llm.near_copies import drop_near_copies
from tests.llm.test_operators import SF, roots


def shingle_set(text):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """doc_ids of the first row of each component of pairs at Jaccard 0.8 or more; rows: (id, text) in order of id."""
    sets, holders, shared = [shingle_set(t) for _, t in rows], defaultdict(list), defaultdict(int)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for held in holders.values():
        for pair in combinations(held, 2):
            shared[pair] += 1
    links = [(a, b) for (a, b), n in shared.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))]
    links += combinations([k for k, s in enumerate(sets) if not s], 2)
    return {rows[k][0] for k, root in enumerate(roots(len(rows), links)) if k == root}


def kept_ids(docs):
    return sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stage_equals_all_pairs(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert kept_ids(stage(spark, docs, SF)) == sorted(brute_kept(rows))
    assert len(brute_kept(rows)) < len({t for _, t in rows})


def test_edited_copies_in_groups_and_chains(spark):
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    rows = []
    for size in (1, 2, 3, 90):  # copies of one text, each edited in its own places
        base = words(300)
        for _ in range(size):
            copy = list(base)
            for at in draw.sample(range(300), draw.randrange(0, 12)):
                copy[at] = words(1)[0]
            rows.append(" ".join(copy))
    chain = words(200)
    for _ in range(8):  # each like the next, the ends unlike
        rows.append(" ".join(chain))
        chain = chain[12:] + words(12)
    rows += ["", None, "  ", "a b", "A  b", "a c"]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert kept_ids(drop_near_copies(docs)) == sorted(brute_kept(rows))
    assert drop_near_copies(docs.where("false")).count() == 0


def test_internal_names_as_columns(spark):
    """A column named like anything the stages use inside comes back as it was."""
    names = "_id _mark _row row mark doc size runs n_words n_removed kept at path anchor digest node n bands band part first lead degree _doc copy spans sets set h fp key".split()
    rows = [(i, f"the same text of some more words than five, number {i // 2} of the thing and the other", *[f"{n}{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], ", ".join(["doc_id bigint", "text string", *[f"`{n}` string" for n in names], "lang string"]))
    for stage in ("simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "language_id"):
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)


def test_pairs_at_the_threshold_share_a_block():
    """SimHashes of sets at 0.8 differ in about 15 % of their bits, and have an equal block at any number of texts."""
    draw = np.random.default_rng(3)
    for texts in (10, 10 ** 6, 10 ** 8):
        blocks = near_copies.Blocks.of(texts)
        bits = 64 * near_copies.CHECK_WORDS + np.arange(blocks.count * blocks.bits)
        for both, own in ((400, 50), (80, 10), (4, 0)):  # in common, and in each alone; of the last one has one more
            apart, equal, checks = [], [], []
            for _ in range(40):
                held = draw.integers(0, 1 << 64, both + 2 * own + 1, dtype=np.uint64)
                one, two = held[: both + own], np.append(held[:both], held[both + own : both + 2 * own + (own == 0)])
                a, b = (near_copies.simhash(x, blocks.words) for x in (one, two))
                differ = (a != b)[bits].reshape(blocks.count, blocks.bits)
                apart.append(differ.mean())
                equal.append((~differ.any(axis=1)).sum())
                checks.append((a != b)[: bits[0]].sum())
            assert abs(np.mean(apart) - near_copies.APART) < 0.045 and min(equal) > 0 and max(checks) <= near_copies.CHECK_APART


def test_sight_in_buckets(monkeypatch):
    """Groups of a bucket against all pairs; those of a large bucket are one."""
    draw = np.random.default_rng(4)
    entries = np.zeros(300, dtype=near_copies.ENTRY)
    entries["key"], entries["n"] = np.sort(draw.integers(0, 9, 300)), draw.integers(80, 120, 300)
    base = draw.integers(0, 1 << 64, (20, near_copies.CHECK_WORDS), dtype=np.uint64)
    flips = np.packbits(draw.random((300, 128)) < 0.14, axis=1).view(np.uint64)
    entries["check"] = base[draw.integers(0, 20, 300)] ^ flips

    def see(i, j):
        a, b = entries[i], entries[j]
        return a["key"] == b["key"] and 5 * min(a["n"], b["n"]) >= 4 * max(a["n"], b["n"]) and int(np.bitwise_count(a["check"] ^ b["check"]).sum()) <= near_copies.CHECK_APART

    want = roots(300, [(i, j) for i, j in combinations(range(300), 2) if see(i, j)])
    assert near_copies.in_sight(entries).tolist() == list(want)
    assert 20 < len(set(want)) < 250
    monkeypatch.setattr(near_copies, "PAIRED", 1)
    assert len(set(near_copies.in_sight(entries).tolist())) == len(set(entries["key"].tolist()))

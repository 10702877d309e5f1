"""Corpus operators against brute force, on odd rows and on the supplied small tables."""

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from surfaudit.llm.bpe import RANKS, decode_ids, encode_texts, merge_ranks, Vocabulary
from surfaudit.llm.common import table
from surfaudit.llm.decontaminate import contamination_report, drop_contaminated
from surfaudit.llm.html_text import main_text, page_texts
from surfaudit.llm.language import identify_languages, keep_identified
from surfaudit.llm.lm_scoring import START, score_documents
from surfaudit.llm.resampling import clean_ids, kth_largest, resample
from surfaudit.llm import sharding
from surfaudit.llm.sharding import shard_documents
from surfaudit.llm.simhash import MAX_BITS, drop_near_copies, fingerprint, fingerprint_links, simhash_components
from surfaudit.llm.substring import dedup_substrings, drop_repeated_spans
from surfaudit.llm.vectors import near_vectors

SF = "/root/testdata/sf0.001"
BYTE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def roots(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# language ------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert sum(r.accepted for r in found) > 0.99 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(odd_docs, no_docs):
    found = identify_languages(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and not by[1].accepted and by[1].score == 0
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    assert identify_languages(no_docs).count() == 0
    # Nothing to learn from: every text is unknown.
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}
    assert keep_identified(odd_docs).columns == odd_docs.columns


# substrings ----------------------------------------------------------------------------------


def brute_substrings(rows, window=20):
    """rows: (id, text) in order of their coordinates -> (n_words, n_removed, kept) per row."""
    words = [BYTE_WORDS.findall(t.encode()) if t else [] for _, t in rows]
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    gone = [set() for _ in rows]
    for k in order:
        for s in range(len(words[k]) - window + 1):
            key = tuple(words[k][s : s + window])
            if key in seen:
                gone[k].update(range(s, s + window))
            else:
                seen[key] = (k, s)
    for k, w in enumerate(words):
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone[k]).decode()
        out.append((len(w), len(gone[k]), kept))
    return out


@pytest.mark.parametrize("sf", [SF])
def test_substrings_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted(pairs(docs, "doc_id", "text"))
    got = sorted(pairs(dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept"))
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_substrings(rows))]
    assert any(r[2] for r in got)


def test_substrings_odd_rows(odd_docs, no_docs):
    found = dedup_substrings(odd_docs)
    assert found.columns == [c for c in odd_docs.columns if c != "kept"] + ["n_words", "n_removed", "kept"]
    # The null id sorts first; ids 20 and 21 repeat and are told apart by text, twins are one.
    single = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (20, 21)")
    rows = sorted({(i if i is not None else -1, t or "") for i, t in pairs(single, "doc_id", "text")})
    want = {(i, t): x for (i, t), x in zip(rows, brute_substrings(rows))}
    for i, t, *x in pairs(dedup_substrings(single), "doc_id", "text", "n_words", "n_removed", "kept"):
        assert tuple(x) == want[(i if i is not None else -1, t or "")]
    twins = [r for r in pairs(found, "doc_id", "n_removed") if r[0] == 21]
    assert twins == [(21, 0), (21, 0)]
    assert dedup_substrings(no_docs).count() == 0


def test_stage_keeps_untouched_texts(odd_docs):
    kept = drop_repeated_spans(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    by = {r.doc_id: r.text for r in kept.collect() if r.doc_id}
    assert 10 not in by and 7 not in by  # whole copies of the text without an id
    assert by[3] == " \t\n " and by[1] is None and by[5] == "a b"
    assert by[12] == "word"  # every window but the first starts earlier too


# decontamination -----------------------------------------------------------------------------


def lowered(text):
    return ITEM_WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = lowered(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(item) if item is not None else "")
    out = []
    for i, text in docs:
        w, hit, found = lowered(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((-1 if i is None else i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out)


def test_contamination_equals_brute_force(spark, odd_docs, no_docs):
    items = [(0, None), (1, ""), (2, "..."), (3, "one"), (4, "NAÏVE éa b"), (5, " ".join(["same", "word"] * 6)), (6, " ".join(["word"] * 30)), (None, "a b"), (7, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cols = ("doc_id", "n_words", "n_hit", "items", "contaminated")
    got = sorted((-1 if i is None else i, *x) for i, *x in pairs(contamination_report(odd_docs, bench), *cols))
    assert got == brute_contamination(pairs(odd_docs, "doc_id", "text"), items)
    assert drop_contaminated(odd_docs, bench).count() == sum(not r[4] for r in got)
    assert drop_contaminated(odd_docs, bench).columns == odd_docs.columns
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in contamination_report(odd_docs, none).collect())
    assert contamination_report(no_docs, bench).count() == 0


# byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, odd_docs, no_docs, encoding):
    tricky = ["it's we'll 'LL ''s 's", "a  b\n\n c\t\r\n", "x" * 3000, "ab" * 500, " 　  9²½ ß漢🎉", "<|endoftext|>", "\n", " ", "'"]
    docs = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id bigint, text string"))
    coded = encode_texts(docs)
    got = [(r[0], r[1], r[2]) for r in pairs(coded.withColumn("bytes", decode_ids("ids", "offsets")), "doc_id", "ids", "bytes")]
    want = [(i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs(docs, "doc_id", "text")]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((i, list(x), bytes(b)) for i, x, b in got), key=key) == sorted(want, key=key)
    assert encode_texts(no_docs).count() == 0


def test_long_pieces_merge_like_short_ones():
    ranks = Vocabulary.load(public_tokenizers.path(RANKS)).ranks
    import surfaudit.llm.bpe as bpe

    rng = np.random.default_rng(1)
    for _ in range(50):
        piece = bytes(rng.choice(list(b"abetnis "), size=60).tolist())
        assert bpe._merge_long(piece, ranks) == merge_ranks(piece, ranks)


# near copies ---------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = BYTE_WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(odd_docs, no_docs):
    rows = pairs(odd_docs, "doc_id", "text")
    prints = [slow_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= MAX_BITS])
    low = {}
    for r, (i, _) in zip(root, rows):
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((i, p, low[r]) for (i, _), p, r in zip(rows, prints, root)), key=key)
    got = [(i, fp % (1 << 64), c) for i, fp, c in pairs(simhash_components(odd_docs), "doc_id", "fp", "component_id")]
    assert sorted(got, key=key) == want
    assert fingerprint(b"A b C d") == fingerprint(b"a B c D")
    kept = drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(root))
    assert simhash_components(no_docs).count() == 0


def test_large_buckets_give_the_same_components(spark):
    """More fingerprints in one bucket than are compared pair by pair."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 24, size=(600, 3))})
    links = pairs(fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint")), "src", "dst")
    at = {p: k for k, p in enumerate(prints)}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    brute = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert roots(len(prints), [(at[a], at[b]) for a, b in links]) == roots(len(prints), brute)


# pages ---------------------------------------------------------------------------------------

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor. " * 4
PARA = f"<p>{LONG}</p>"
CLEAN = LONG.strip()


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<script>x</script>", ""), ("plain &lt;text&gt;", "plain <text>"),
        (f"<nav><a href=1>Home</a></nav><article><h1>T &amp;\n U</h1>{PARA}<p>Short<br>line</article><footer>end</footer>", f"T & U\n{CLEAN}\nShort line"),
        (f"<body><header><h1>Site</h1></header><main><article><header><h1>T</h1></header>{PARA}<div class='ad-box'>Buy</div><aside>s</aside>{PARA}"
         f"<section id=comments>{PARA}</section></article></main><div id='cookie-notice'>{PARA}</div>", f"T\n{CLEAN}\n{CLEAN}"),
        (f"<body><div class=menu><a href=1>a</a></div><div id=wrap><div class=story><h2>T</h2>{PARA}<p>x</p>{PARA}</div><div class=sidebar>{PARA}</div></div>"
         f"<div class=footer>c</div><form>{PARA}</form>", f"T\n{CLEAN}\nx\n{CLEAN}"),
        (f"<div class='has-sidebar'><article>{PARA}<ul><li>one<li>two</ul><p hidden>h</p></article></div>", f"{CLEAN}\none\ntwo"),
        (f"<div><article>{PARA}<p>open <b>bold", f"{CLEAN}\nopen bold"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_pages_keep_the_article(spark):
    pages = table(spark, SF, "pages")
    for r in page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1)], "page_id bigint, url string, html string, text int")
    assert sorted(pairs(page_texts(odd), "text", "n_chars")) == [("", 0)] * 3


# resampling and scoring ----------------------------------------------------------------------


def test_resampling(spark, odd_docs, no_docs):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = resample(docs, clean_ids(labels), 0.5).collect()
    chosen = [r for r in found if r.selected]
    assert len(found) == 200 and abs(len(chosen) - 100) <= 1
    assert min(r.sample_key for r in chosen) >= max(r.sample_key for r in found if not r.selected) - 1e-6
    good = {r.doc_id: r.quality for r in labels.collect()}
    share = lambda q: np.mean([r.selected for r in found if good.get(r.doc_id) == q])
    assert share(1) > share(0)
    none = clean_ids(labels.where("false"))
    odd = resample(odd_docs, none, 1.0).collect()
    assert len(odd) == odd_docs.count()
    assert all(r.selected == (r.log_weight is not None) for r in odd)
    assert {r.doc_id for r in odd if r.log_weight is None} >= {1, 2, 3}
    assert resample(no_docs, none, 0.5).count() == 0


def test_kth_largest(spark):
    values = [5, -3, 5, 1 << 40, -(1 << 50), 0, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    assert [kth_largest(df, "v", k) for k in range(1, 10)] == sorted(values, reverse=True)
    assert kth_largest(df.where("v IS NULL"), "v", 1) is None


def brute_losses(texts, order=4):
    """Witten-Bell, from counts of all orders: a function text -> mean loss."""
    grams, contexts, kinds = Counter(), Counter(), defaultdict(set)
    for t in texts:
        held = START + (t or "").encode()
        for i in range(order - 1, len(held)):
            for n in range(1, order + 1):
                gram = held[i - n + 1 : i + 1]
                grams[gram] += 1
                contexts[n, gram[:-1]] += 1
                kinds[n, gram[:-1]].add(gram)

    def chance(gram):
        if not gram:
            return 1 / 256
        n, c = len(gram), gram[:-1]
        whole = contexts[n, c] + len(kinds[n, c])
        lower = chance(gram[1:])
        return (grams[gram] + len(kinds[n, c]) * lower) / whole if whole else lower

    def loss(text):
        held = START + text.encode()
        each = [-math.log(chance(held[i - order + 1 : i + 1])) for i in range(order - 1, len(held))]
        return sum(each) / len(each)

    return loss


def test_lm_scores_equal_brute_force(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(7,), (13,), (99,)], "_id bigint")
    rows = pairs(odd_docs, "doc_id", "text")
    back, near = brute_losses([t for _, t in rows]), brute_losses([t for i, t in rows if i in (7, 13)])
    found = pairs(score_documents(odd_docs, target), "doc_id", "n_tokens", "loss_target", "loss_background", "ce_diff")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(i, len((t or "").encode()), near(t) if t else None, back(t) if t else None) for i, t in rows], key=key)
    assert len(found) == len(want)
    seen = sorted(found, key=key)
    for (i, n, lt, lb, d), (wi, wn, wt, wb) in zip(sorted(seen, key=lambda r: (key(r), r[2] or 0)), sorted(want, key=lambda r: (key(r), r[2] or 0))):
        assert (i, n) == (wi, wn)
        assert (lt is None and wt is None) or (abs(lt - wt) < 1e-9 and abs(lb - wb) < 1e-9 and abs(d - (wt - wb)) < 1e-9)
    assert score_documents(no_docs, target).count() == 0


# vectors -------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    close = base[:20, None, :] + 0.12 * rng.standard_normal((20, 5, 16))
    x = np.concatenate([base, close.reshape(-1, 16), base[:3], base[:1]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, [1.0, 2.0]), (None, None)]
    odd.append((906, [None] + [1.0] * 15))
    df = spark.createDataFrame(rows + [(i, v, 0) for i, v in odd], "vec_id bigint, embedding array<float>, links int")
    got = {r.vec_id: r for r in near_vectors(df, recall=0.9999).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    assert len(got) == len(rows) + len(odd)
    root = roots(len(x), [(a, b) for a in range(len(x)) for b in range(a) if linked[a, b]])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum() - 1, root[i], root[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert near_vectors(df.where("false")).count() == 0


def test_vector_recall_on_pairs_at_the_threshold(spark):
    """Pairs right at the cosine that is asked for, among many unrelated vectors."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((600, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((600, 32))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.905 * a + math.sqrt(1 - 0.905**2) * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    assert np.mean([got[i] >= 1 for i in range(600)]) >= 0.9


# sharding ------------------------------------------------------------------------------------


def test_shards(spark, odd_docs, no_docs):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = shard_documents(docs, shards=16).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = Counter()
    slots = defaultdict(list)
    for r in found:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(found) == len(texts) and sorted(size) == list(range(16))
    largest = max(len(t.encode()) for t in texts.values())
    assert max(size.values()) - min(size.values()) <= 4 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = shard_documents(odd_docs, shards=3).collect()
    assert len(odd) == odd_docs.count() and {r.shard for r in odd} <= {0, 1, 2}
    assert {(r["size"], r.text_crc32) for r in odd if r.doc_id == 1} == {(1, 0)}
    assert shard_documents(no_docs, shards=16).count() == 0


def test_equal_rows_and_a_hot_text_in_many_shards(spark):
    """Half of all rows are one row, and a shard is a small part of it: sizes stay near equal."""
    rows = [(7, "one row " * 10)] * 3000 + [(i, f"text {i} " * 9) for i in range(1000)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = shard_documents(df, shards=300).collect()
    size, slots = Counter(), defaultdict(list)
    for r in found:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 300
    assert len(found) == len(rows) and len(size) == 300 and all(abs(s - mean) <= 110 for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_cut(points, leaves, axis_of):
    """Shards of (keys, bytes) points by exact weighted medians, with the operator's choice of axes."""
    if leaves == 1 or not points:
        return [points]
    axis = axis_of(points)
    points = sorted(points, key=lambda p: p[0][axis])
    left, total, best = (leaves + 1) // 2, sum(b for _, b in points), None
    want, run = total * left / leaves, 0
    for i, (_, b) in enumerate(points):
        if run + b >= want:
            best = i + 1 if run + b - want < want - run else i
            break
        run += b
    return brute_cut(points[:best], left, axis_of) + brute_cut(points[best:], leaves - left, axis_of)


def test_shards_equal_a_brute_force_tree(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(1, 60))), draw.choice(["en", "de"]), f"s{draw.randrange(5)}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    groups = sharding._groups(sharding._rows(df, "doc_id", "text").cache()).collect()
    points = [((*r["keys"],), r["bytes"]) for r in groups]
    spread = lambda p: max(range(4), key=lambda a: (max(k[a] for k, _ in p) - min(k[a] for k, _ in p), -a))
    want = [sum(b for _, b in shard) for shard in brute_cut(points, 11, spread)]
    size = Counter()
    for r in shard_documents(df, shards=11).collect():
        size[r.shard] += r["size"]
    # A median is exact to a grain, so cuts may differ by one text.
    assert all(abs(size[i] - w) <= 2 * 250 for i, w in enumerate(want)) and sum(size.values()) == sum(want)


def test_shards_by_target_and_hot_text(spark):
    """A third of all rows have one text: it is dealt out, and the rest stays together."""
    rows = [(i, "hot text " * 20) for i in range(500)] + [(500 + i, f"text {i} " * 12) for i in range(1000)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), target_bytes=20_000).collect()
    size = Counter()
    for r in found:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / len(size)
    assert len(size) == -(-sum(size.values()) // 20_000) and all(abs(s - mean) < 0.05 * mean for s in size.values())


"""Spelling variants: words one letter apart, found in tries of letter-group counts.

Two words one edit apart agree before the edit and after it.  So words are dealt into cells that
know where the edit lies: words of a cell share all letters outside a region, a cell that is too
full is cut into two with half the region each, and a pair meets in exactly one cell.  Inside the
cells words are arranged in a trie by how many letters of each group they have, group after group.
One edit is at most one letter more and one less, so a depth-first search over the trie spends a
surplus and a deficit of one each; the words at the leaves it reaches are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.llm.common import materialize, text_bytes

# Letters of a run, the length and number of a word, the share of a slip, the lead of a form.
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LETTERS = 7
LEAST_COUNT = 2
SLIP = 31
LEAD = 10

GROUPS = 8  # a letter belongs to the group of its code point modulo this
CELL = 512  # words of a cell beyond which its region is halved
HELD_COUNTS = 1 << 17  # words a task counts before it hands the counts on
CHUNK_ROWS = 1 << 15  # words of whole cells searched together ...
CHUNK_LETTERS = 1 << 21  # ... and their letters
BLOCK = 1 << 16  # branches, or pairs to verify, that are held at once
PLACE = ["len", "lo", "hi", "cell"]


def slipped(run: str, state: int) -> str:
    """The run, or without one letter where the checksum of document and run asks for it."""
    h = zlib.crc32(run.encode(), state)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters or more that occur LEAST_COUNT times or more.

    A null text has no words; a null id counts as an empty one.
    """
    runs = re.compile(f"{RUN}{{{LEAST_LETTERS},}}")  # shorter runs never become words

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), text_bytes(batch)):
                if not text:
                    continue
                state = zlib.crc32(f"{doc}:".encode())
                # A run slips alike wherever a document has it.
                for word, n in Counter(runs.findall(text.lower().decode())).items():  # bytes: A-Z only
                    word = slipped(word, state)
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) >= HELD_COUNTS:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _cell(length: Column, lo: Column, hi: Column) -> Column:
    """Names the cell of words that share lo letters at the front and length - hi at the end."""
    tail = length - hi
    end = F.when(tail > 0, F.substring("word", F.char_length("word") - tail + 1, tail)).otherwise("")
    return F.xxhash64(length, lo, hi, F.substring("word", F.lit(1), lo), end)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row of a region of two letters or more, once for each half."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    cut = rows.select("word", "n", "len", F.explode(halves).alias("half")).select("word", "n", "len", "half.lo", "half.hi")
    return cut.withColumn("cell", _cell(F.col("len"), F.col("lo"), F.col("hi")))


def edit_cells(words: DataFrame) -> DataFrame:
    """(word, n, len, lo, hi, cell): words by where one edit could lie.

    ``len`` is the shorter length of a pair, so a word takes part with its length and one less.
    """
    letters = F.char_length("word")
    lengths = F.filter(F.array(letters, letters - 1), lambda x: x >= LEAST_LETTERS)
    rows = words.select("word", "n", F.explode(lengths).alias("len")).withColumns({"lo": F.lit(0), "hi": F.col("len")})
    rows, done = materialize(_halved(rows)), None
    while True:  # regions are halved, so their rounds are few
        full = rows.where(F.col("hi") - F.col("lo") > 1).groupBy("len", "lo", "hi", "cell").agg(F.count(F.lit(1)).alias("k"))
        full = materialize(full.where(F.col("k") > CELL).select(*PLACE))
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        some = rows.join(full, PLACE, "left_anti").select(*rows.columns)
        done = some if done is None else done.unionByName(some)
        rows = materialize(_halved(rows.join(full, PLACE, "left_semi").select(*rows.columns)))


class Cells:
    """The words of whole cells as a letter matrix, and a trie of their letter-group counts."""

    def __init__(self, words: list[str], n: np.ndarray, place: np.ndarray):
        """``place`` has the columns of PLACE, rows of a cell together."""
        self.words, self.n, self.place = words, n, place
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.width = int(self.size.max()) + 2
        flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        self.letters = np.zeros((len(words), self.width), dtype=np.uint8)
        self.letters[np.repeat(np.arange(len(words)), self.size), np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat
        # Level k of the trie: sorted codes of (node above, count of group k).
        at = np.zeros(len(words), dtype=np.int64)
        at[1:] = np.cumsum((place[1:] != place[:-1]).any(axis=1))
        self.root = at
        group = np.where(self.letters > 0, self.letters % GROUPS, GROUPS)
        self.span = self.width + 2
        self.levels, counts = [], []
        for k in range(GROUPS):
            c = (group == k).sum(axis=1) + 1  # one below zero stays apart from all others
            codes, at = np.unique(at * self.span + c, return_inverse=True)
            self.levels.append(codes)
            counts.append(c)
        self.order = np.argsort(at, kind="stable")  # rows by leaf
        self.begin = np.append(np.searchsorted(at[self.order], np.arange(len(codes))), len(words))
        lead = self.order[self.begin[:-1]]
        self.counts = np.column_stack([c[lead] for c in counts])  # of each leaf
        self.leaf_root = self.root[lead]
        self.leaf_long = self.size[lead] > place[lead, 0]  # words of one leaf are of one length

    def leaf_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves of the shorter length, and the leaves of words that may be one edit away."""
        asks = np.flatnonzero(~self.leaf_long)
        for i in range(0, len(asks), BLOCK):
            ask = asks[i : i + BLOCK]
            spare = np.ones(len(ask), dtype=bool)
            stack = [(0, ask, self.leaf_root[ask], spare, spare)]
            while stack:
                k, ask, node, more, less = stack.pop()
                if len(ask) > BLOCK:
                    half = len(ask) // 2
                    stack += [(k, ask[s], node[s], more[s], less[s]) for s in (slice(None, half), slice(half, None))]
                    continue
                if k == GROUPS:
                    ok = more <= less  # a surplus alone is a letter more, a deficit alone a shorter word
                    yield ask[ok], node[ok]
                    continue
                parts = []
                for step, may in ((0, None), (1, more), (-1, less)):
                    on = slice(None) if may is None else np.flatnonzero(may)
                    code = node[on] * self.span + self.counts[ask[on], k] + step
                    at = np.minimum(np.searchsorted(self.levels[k], code), len(self.levels[k]) - 1)
                    met = self.levels[k][at] == code
                    parts.append((ask[on][met], at[met], (more[on] & (step < 1))[met], (less[on] & (step > -1))[met]))
                stack.append((k + 1, *map(np.concatenate, zip(*parts))))

    def near_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of words one edit apart, each pair once."""
        for one, two in self.leaf_pairs():
            once = self.leaf_long[two] | (one <= two)
            one, two = one[once], two[once]
            across = np.diff(self.begin)[two]
            # Every word of the one leaf with the whole other leaf, then cut into blocks.
            times = np.diff(self.begin)[one]
            rows = np.repeat(self.begin[one], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, count = np.repeat(self.begin[two], times), np.repeat(across, times)
            most = max(1, min(BLOCK, CHUNK_LETTERS // self.width))
            ends = np.cumsum(count)
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
                c = count[i:j]
                a = np.repeat(rows[i:j], c)
                b = np.repeat(start[i:j], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                keep = (a < b) | (self.size[self.order[a]] != self.size[self.order[b]])
                yield self._verified(self.order[a[keep]], self.order[b[keep]])
                i = j

    def _verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that are one edit apart with the edit in the region of their cell."""
        length, lo, hi = (self.place[a, c] for c in range(3))
        left, right = self.letters[a], self.letters[b]
        other = left != right
        at = other.argmax(axis=1)  # where they part
        here = (at >= lo) & ((at < hi) | (hi == length)) & other.any(axis=1)
        longer = self.size[b] > length
        after = (left[:, :-1] != right[:, 1:]) & (np.arange(self.width - 1) >= at[:, None])
        good = here & np.where(longer, ~after.any(axis=1), other.sum(axis=1) == 1)
        return a[good], b[good]

    def summed(self) -> pa.RecordBatch | None:
        """(word, n_near, best_n, best) over the pairs of these cells."""
        pairs = list(self.near_pairs())
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64) for i in (0, 1))
        if not len(a):
            return None
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        rank = np.empty(len(self.words), dtype=np.int64)
        rank[np.argsort(self.letters.view(f"S{self.width}").ravel(), kind="stable")] = np.arange(len(self.words))
        by = np.lexsort((rank[b], -self.n[b], a))
        a, b = a[by], b[by]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        name = self.words.__getitem__
        columns = [list(map(name, a[start])), np.diff(np.append(start, len(a))), self.n[b[start]], list(map(name, b[start]))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches whole cells, as many together as the bounds allow; rows come cell by cell."""
    held: list[tuple[list[str], np.ndarray, np.ndarray]] = []

    def done() -> Iterator[pa.RecordBatch]:
        words = [w for part in held for w in part[0]]
        found = Cells(words, *(np.concatenate([part[i] for part in held]) for i in (1, 2))).summed()
        held.clear()
        if found is not None:
            yield found

    rows = letters = 0
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        place = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in PLACE])
        heads = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(axis=1)))
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(words)]):
            fresh = not held or (held[-1][2][-1] != place[i]).any()
            if fresh and held and (rows >= CHUNK_ROWS or letters >= CHUNK_LETTERS):
                yield from done()
                rows = letters = 0
            held.append((words[i:j], n[i:j], place[i:j]))
            rows, letters = rows + j - i, letters + (j - i) * int(place[i, 0] + 3)
    if held:
        yield from done()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit away, and the most frequent of them."""
    cells = edit_cells(words)
    dealt = cells.repartition(*PLACE).sortWithinPartitions(*PLACE)
    found = dealt.mapInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def spelling_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the end of the chain of forms.

    Each round doubles the steps taken; counts grow along a chain LEAD-fold, so rounds are few.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = materialize(now.join(ahead, "root", "left"))
        now = both.select("word", F.coalesce("next", "root").alias("root"))
        if both.where("next IS NOT NULL").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``docs``.

    Words are what ``word_counts`` has.  ``n_near`` counts the words one inserted, deleted or
    replaced letter away; the most frequent of them (ties: the first in code-point order) is the
    form, if it is LEAD times as frequent as the word or more, else form and form_n are null.
    ``root`` ends the chain of forms, and is the word itself where it has none.  Repeated rows
    count each; an empty table, or one of null or empty texts, gives no row; words of any length
    are handled whole.  Other columns are not read.
    """
    words = materialize(word_counts(docs, id_col, text_col))
    near = words.join(near_words(words), "word", "left")
    led = F.col("best_n") >= LEAD * F.col("n")
    near = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n"),
    ))
    roots = spelling_roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Test passages inside corpus documents: size-partitioned MinHash containment search.

A test item leaks into a document if `run_words` (12) consecutive words of its passage stand there one
after the other. Every run of that many passage words is a query set of word shingles (five words each);
documents are cut into overlapping blocks of words such that each run of `run_words` words lies whole in
one block. Blocks are partitioned by the number of their shingles. For a query of q shingles wholly
contained in a block of at most u shingles the Jaccard similarity is at least q/u, so each size partition
consults just as many one-row MinHash bands as make a miss less likely than `miss` (1e-9). Blocks that
collide with a query in any band are verified by exact containment: the words of the run are compared.

Documents are only read by a map stage: nothing of them is shuffled but the found pairs. The items are
sent to the tasks in passes of at most `items_per_pass` items, whatever their number; with more than one pass the documents are folded
once and the folded texts written, which the passes read.

Null or empty texts and passages, and passages shorter than a run, match nothing; rows whose id is null
are left out; repeated rows give one result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.llm.folding import fold_words
from lexspace.storage import materialise, ship_package

RUN_WORDS = 12
SHINGLE_WORDS = 5
BLOCK_WORDS = 24
ITEMS_PER_PASS = 2000
SIZE_STEP = 4
MISS = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries of a uint64 array."""
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = h * _BASE + words[i : i + size]
    return _mixed(h)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class PassageIndex:
    """MinHash bands and exact runs of a bounded set of passages."""

    def __init__(self, items: list[tuple[int, str | None]], run_words: int, shingle_words: int, miss: float):
        self.run, self.shingle, self.block = run_words, shingle_words, max(BLOCK_WORDS, 2 * run_words)
        self.per_run = run_words - shingle_words + 1
        self.runs: dict[int, list[tuple[tuple[str, ...], int, int]]] = defaultdict(list)
        self.n_words: dict[int, int] = {}
        shingles = []
        for item, passage in items:
            words = fold_words(passage)
            self.n_words[item] = len(words)
            if len(words) < run_words:
                continue
            h = np.array([word_hash(w) for w in words], np.uint64)
            s = gram_hashes(h, shingle_words)
            for i, g in enumerate(gram_hashes(h, run_words).tolist()):
                self.runs[g].append((tuple(words[i : i + run_words]), item, i))
                shingles.append(s[i : i + self.per_run])
        self.run_keys = np.array(sorted(self.runs), np.uint64)
        self.sets = np.array(shingles, np.uint64).reshape(-1, self.per_run)
        distinct = min((len(set(r)) for r in self.sets.tolist()), default=self.per_run)
        #: upper bound of a partition's shingles -> number of bands
        self.bands: dict[int, int] = {}
        for upper in range(self.per_run, self.block - shingle_words + 1 + SIZE_STEP, SIZE_STEP):
            jaccard = distinct / (upper - self.per_run + distinct)
            self.bands[upper] = 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log1p(-jaccard))
        rng = np.random.default_rng(20)
        n = max(self.bands.values())
        self.factor = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mask = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.minima = [np.unique(self._band(self.sets, j)) for j in range(n)] if len(self.sets) else []
        self.seen = []
        for m in self.minima:
            bits = np.zeros(1 << 18, bool)
            bits[m & np.uint64((1 << 18) - 1)] = True
            self.seen.append(bits)

    def _band(self, sets: np.ndarray, j: int) -> np.ndarray:
        return ((sets ^ self.mask[j]) * self.factor[j]).min(axis=1)

    def colliding(self, shingles: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which blocks (first shingle, number of shingles) share a minimum with any query set."""
        hit = np.zeros(len(starts), bool)
        lower = 0
        for upper, n in self.bands.items():
            rows = np.flatnonzero((counts > lower) & (counts <= upper))
            lower = upper
            if not len(rows):
                continue
            sets = shingles[starts[rows][:, None] + np.minimum(np.arange(upper), counts[rows][:, None] - 1)]
            live = np.zeros(len(rows), bool)
            for j in range(n):
                m = self._band(sets, j)
                near = np.flatnonzero(self.seen[j][m & np.uint64((1 << 18) - 1)])
                at = np.searchsorted(self.minima[j], m[near])
                live[near[self.minima[j][np.minimum(at, len(self.minima[j]) - 1)] == m[near]]] = True
            hit[rows[live]] = True
        return hit

    def search(self, ids: list, texts: list, folded: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, longest run in words, passage words covered, passage words) of a batch; folded texts are words with single spaces."""
        if not len(self.run_keys):
            return
        known: dict[str, int] = {}
        hashes, words, owner, starts, counts = [], [], [], [], []
        step, at = self.block - self.run + 1, 0
        for doc, text in zip(ids, texts, strict=True):
            if doc is None or not text:
                continue
            ws = text.split(" ") if folded else fold_words(text)
            if len(ws) < self.run:
                continue
            for w in ws:
                if w not in known:
                    known[w] = word_hash(w)
            hashes.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
            words.append((at, ws))
            for b in range(0, len(ws) - self.run + 1, step):
                owner.append((doc, len(words) - 1))
                starts.append(at + b)
                counts.append(min(self.block, len(ws) - b) - self.shingle + 1)
            at += len(ws)
        if not words:
            return
        flat = np.concatenate(hashes)
        starts, counts = np.array(starts), np.array(counts)
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for b in np.flatnonzero(self.colliding(gram_hashes(flat, self.shingle), starts, counts)).tolist():
            doc, k = owner[b]
            first, ws = words[k]
            size = int(counts[b]) + self.shingle - 1
            grams = gram_hashes(flat[starts[b] : starts[b] + size], self.run)
            at = np.minimum(np.searchsorted(self.run_keys, grams), len(self.run_keys) - 1)
            for i in np.flatnonzero(self.run_keys[at] == grams).tolist():
                p = int(starts[b]) - first + i
                run = tuple(ws[p : p + self.run])
                for same, item, place in self.runs[int(grams[i])]:
                    if same == run:
                        found[doc, item].add(place)
        for (doc, item), places in found.items():
            longest = streak = covered = 0
            last = None
            for p in sorted(places):
                streak = streak + 1 if last is not None and p == last + 1 else 1
                longest = max(longest, streak)
                covered += self.run if last is None else min(self.run, p - last)
                last = p
            yield doc, item, longest + self.run - 1, covered, self.n_words[item]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(fold_words(t)) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    run_words: int = RUN_WORDS,
    shingle_words: int = SHINGLE_WORDS,
    miss: float = MISS,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """One row per document and item of which at least `run_words` consecutive words stand in it.

    Columns: doc_id, item_id, longest_run, words_covered, passage_words.
    """
    spark = documents.sparkSession
    ship_package(spark)
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
    n = rows.count()
    passes = max(1, math.ceil(n / items_per_pass))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, longest_run int, words_covered int, passage_words int"
    if passes > 1:
        docs = materialise(docs.mapInArrow(_folded, "doc_id long, text string"), "p8-folded")
    out = None
    for k in range(passes):
        some = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        index = spark.sparkContext.broadcast(PassageIndex([(r.i, r.p) for r in some.collect()], run_words, shingle_words, miss))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(index.value.search(b.column(0).to_pylist(), b.column(1).to_pylist(), passes > 1))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                columns = list(zip(*got, strict=True)) if got else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "longest_run", "words_covered", "passage_words"],
                )

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("longest_run").alias("longest_run"),
        F.max("words_covered").alias("words_covered"),
        F.max("passage_words").alias("passage_words"),
    )

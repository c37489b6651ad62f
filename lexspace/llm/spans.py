"""Long exact spans shared between records, by prefix-partitioned sparse suffix trees.

A record is a sequence of symbols: the code points of a text or the tokens of a list. A span of at least
`run` symbols that stands in two records is found as follows.

* Sampling of suffixes: k = run/2; of every window of run-k+1 consecutive k-grams the one with the least hash
  starts a suffix. Each span of `run` symbols holds such a window whole, so equal spans sample equal places.
* A suffix whose k-gram stands in one record only can't lie in a shared span; it is dropped by an aggregate
  of hashes, before any text is moved.
* Vertical partitioning: suffixes are split by prefixes; a prefix with more than `group_suffixes` suffixes is
  lengthened until its groups fit, at most to k symbols.
* In each group the sorted suffixes and the common lengths of neighbours are the subtree of that prefix, the sorted reversed left sides that
  of what stands before. Its deep nodes, of depth k or more, hold the candidates: for every offset o the rows that lie below one node of depth
  run - o on the right and below one of depth o on the left have an equal span there. Depths come from neighbours in sorted order, so a node of n
  suffixes costs n log n for each offset; only small nodes compare their pairs, and pairs are made only of records that do share a span.
* The suffixes of a k-gram that stands more than `hot` times aren't gathered: their spans (a digest of 128 bits for each offset) are aggregated by the
  engine, so a refrain in a third of all records is a few rows for each of them. Of spans with the same records one makes the pairs, in parts of `chunk` records.

Contexts of `run` symbols on each side are enough: shared anchors of one span lie at most run-k+1 apart, so the
pieces seen from them cover the whole span, whatever its length.

Of keys with the same body (a group of copies may hold a third of all) one goes through this; the others get its spans, and are shared as a whole.

Null keys, null or short bodies give no rows. Repeated deliveries of a key (equal bodies) count once; a span that
repeats only within one record isn't shared. Symbols are compared exactly. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspace.llm.leakage import gram_hashes
from lexspace.llm.pairs import pairs_within
from lexspace.storage import discard, materialise, ship_package

END = "\x1f"
GROUP_SUFFIXES = 50_000
HOT, CHUNK, SMALL = 2000, 1000, 64
HELD_ROWS = 1_000_000


def char_body(text: Column) -> Column:
    return text


def token_body(tokens: Column) -> Column:
    """Tokens as one string: each ended by a separator that is escaped within tokens; nulls are left out."""
    clean = F.transform(F.filter(tokens, lambda x: x.isNotNull()), lambda x: F.replace(F.replace(x, F.lit("\x1e"), F.lit("\x1e0")), F.lit(END), F.lit("\x1e1")))
    return F.when(F.size(clean) > 0, F.concat(F.array_join(clean, END), F.lit(END)))


def _symbols(body: str, unit: str) -> np.ndarray:
    if unit == "char":
        return np.frombuffer(body.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    return np.array([xxhash.xxh3_64_intdigest(t) for t in body.split(END)[:-1]], np.uint64)


def anchors(symbols: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a sequence and the hashes of the k-grams there."""
    k = run // 2
    w = run - k + 1
    h = gram_hashes(symbols, k)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = []
    for s in range(0, len(h) - w + 1, 1 << 16):
        part = h[s : s + (1 << 16) + w - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, w)
        keep.append(np.unique(view.argmin(axis=1) + np.arange(len(view))) + s)
    at = np.unique(np.concatenate(keep))
    return at, h[at].view(np.int64)


def _split(body: str, unit: str) -> str | list[str]:
    return body if unit == "char" else body.split(END)[:-1]


def _common(a: str | list[str], b: str | list[str], most: int) -> int:
    """Length of the common beginning, at most `most`."""
    lo, hi = 0, min(len(a), len(b), most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _tree(sides: list, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of some sequences and the common length of each with the next: the depths of the tree's internal nodes."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    return np.array(order), np.array([_common(sides[a], sides[b], run) for a, b in itertools.pairwise(order)], np.int16)


def _depths(order: np.ndarray, lcp: np.ndarray, run: int) -> np.ndarray:
    """Depth of the lowest common node of each pair."""
    n = len(order)
    out = np.full((n, n), run, np.int16)
    for i in range(n - 1):
        row = np.minimum.accumulate(lcp[i:])
        out[order[i], order[i + 1 :]] = row
        out[order[i + 1 :], order[i]] = row
    return out


class Node:
    """The suffixes (number, pos, left, right) below a node of depth run/2."""

    def __init__(self, rows: list[tuple], run: int, small: int = SMALL):
        self.run, self.small = run, small
        self.number, self.pos = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.right, self.left = _tree([r[3] for r in rows], run), _tree([r[2] for r in rows], run)
        self.most_right, self.most_left = int(self.right[1].max()), int(self.left[1].max())
        self.reach = np.array([len(r[2]) for r in rows]), np.array([len(r[3]) for r in rows])

    def deep_pairs(self) -> tuple[np.ndarray, ...]:
        """(i, j, left, right) of the pairs of rows that share a span."""
        right, left = _depths(*self.right, self.run), _depths(*self.left, self.run)
        i, j = np.nonzero(np.triu((self.number[:, None] != self.number[None, :]) & (right + left >= self.run), 1))
        return i, j, left[i, j], right[i, j]

    def classes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, rows, first of each class among them): rows with an equal span at the offset, in classes of two records or more."""
        n = len(self.number)
        for o in range(max(0, self.run - self.most_right), min(self.run - self.run // 2, self.most_left) + 1):
            label = np.zeros(n, np.int64)
            for (order, lcp), depth in ((self.right, self.run - o), (self.left, o)):
                at = np.empty(n, np.int64)
                at[order] = np.cumsum(np.r_[0, lcp < depth])
                label = label * n + at
            own = np.flatnonzero((self.reach[0] >= o) & (self.reach[1] >= self.run - o))
            own = own[np.lexsort((self.number[own], label[own]))]
            if not len(own):
                continue
            first = np.flatnonzero(np.r_[True, label[own][1:] != label[own][:-1]])
            last = np.r_[first[1:], len(own)] - 1
            many = self.number[own[first]] != self.number[own[last]]
            if many.any():
                size = (last - first + 1)[many]
                rows = np.concatenate([own[a : b + 1] for a, b in zip(first[many], last[many], strict=True)])
                yield o, rows, np.cumsum(size) - size

    def pairs(self) -> Iterator[np.ndarray]:
        """Pairs of numbers (smaller, larger), in bounded arrays; a pair may come repeatedly."""
        if self.most_right + self.most_left < self.run:
            return
        if len(self.number) <= self.small:
            i, j, _, _ = self.deep_pairs()
            yield np.stack([np.minimum(self.number[i], self.number[j]), np.maximum(self.number[i], self.number[j])], axis=1)
            return
        seen: set[bytes] = set()
        for _, rows, first in self.classes():
            for own in np.split(rows, first[1:]):
                numbers = np.unique(self.number[own])
                if (name := xxhash.xxh3_128_digest(numbers.tobytes())) in seen:
                    continue
                seen.add(name)
                step = max(1, HELD_ROWS // len(numbers))
                for lo in range(0, len(numbers), step):
                    a, b = np.nonzero(numbers[lo : lo + step, None] < numbers[None, :])
                    yield np.stack([numbers[lo + a], numbers[b]], axis=1)

    def pieces(self) -> np.ndarray:
        """(number, start, stop) of the widest shared piece around each suffix."""
        n = len(self.number)
        if self.most_right + self.most_left < self.run:
            return np.zeros((0, 3), np.int64)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n <= self.small:
            i, j, l, r = self.deep_pairs()
            for x in (i, j):
                np.maximum.at(left, x, l)
                np.maximum.at(right, x, r)
        else:
            for o, rows, _ in self.classes():
                left[rows] = np.maximum(left[rows], o)
                right[rows] = np.maximum(right[rows], self.run - o)
        x = np.flatnonzero(left + right)
        return np.stack([self.number[x], self.pos[x] - left[x], self.pos[x] + right[x]], axis=1)


def shared_spans(records: DataFrame, runs: dict[str, tuple[str, int]], pairs: bool = True, group_suffixes: int = GROUP_SUFFIXES, hot: int = HOT, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """Of records (field string, number long, body string): with `pairs` (field, number_a, number_b), else (field, number, start, stop).

    runs: field -> ("char" or "token", least length); the latter rows are pieces of shared spans, in symbols.
    """
    spark = records.sparkSession
    ship_package(spark)
    records = records.select("field", F.col("number").cast("long").alias("number"), "body").where("field is not null and number is not null and body is not null")
    members = _copies(records, runs)
    if copied := not members.isEmpty():
        records = records.join(members.where("number <> rep").select("field", "number"), ["field", "number"], "left_anti")

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(field, *anchors(_symbols(body, runs[field][0]), runs[field][1]), number) for field, number, body in zip(f["field"], f["number"], f["body"], strict=True)]
            sizes = [len(x[1]) for x in got]
            yield pd.DataFrame({"field": np.repeat([x[0] for x in got], sizes) if got else [], "number": np.repeat([x[3] for x in got], sizes) if got else [], "pos": np.concatenate([x[1] for x in got]) if got else [], "h": np.concatenate([x[2] for x in got]) if got else []})

    places = materialise(records.mapInPandas(sample, "field string, number long, pos int, h long"), "p1-anchors")
    counts = places.groupBy("field", "h").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi")).where("lo < hi").select("field", "h", "n")
    wanted = places.join(counts, ["field", "h"]).groupBy("field", "number").agg(F.collect_set(F.struct("pos", "n")).alias("places"))
    joined = records.join(wanted, ["field", "number"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for field, number, body, at in zip(f["field"], f["number"], f["body"], f["places"], strict=True):
                unit, run = runs[field]
                seq = _split(body, unit)
                for place in at:
                    pos = int(place["pos"])
                    if place["n"] > hot:
                        out.append((field, number, pos, True, None, None))
                        continue
                    right, left = seq[pos : pos + run], seq[max(0, pos - run) : pos][::-1]
                    if unit == "token":
                        right, left = "".join(t + END for t in right), "".join(t + END for t in left)
                    out.append((field, number, pos, False, left, right))
            yield pd.DataFrame(out, columns=["field", "number", "pos", "hot", "left", "right"])

    suffixes = joined.mapInPandas(cut, "field string, number long, pos int, hot boolean, left string, right string")
    suffixes = materialise(suffixes, "p1-suffixes")
    discard(places)
    keyed = _with_prefix(suffixes.where("not hot").drop("hot"), runs, group_suffixes)
    parts = keyed.repartition("field", "prefix").sortWithinPartitions("field", "right", "number", "pos")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["number_a", "number_b"] if pairs else ["number", "start", "stop"]
        node: list[tuple] = []
        own, held = None, {field: [np.zeros((0, len(columns)), np.int64)] for field in runs}

        def close() -> Iterator[pd.DataFrame]:
            if len(node) > 1 and any(r[0] != node[0][0] for r in node):
                deep = Node(node, runs[own][1], small)
                for new in deep.pairs() if pairs else [deep.pieces()]:
                    held[own].append(new)
                    if sum(map(len, held[own])) > HELD_ROWS:
                        yield flush(own)
            node.clear()

        def flush(field: str) -> pd.DataFrame:
            frame = pd.DataFrame(np.concatenate(held[field]), columns=columns).drop_duplicates()
            held[field] = held[field][:1]
            frame.insert(0, "field", field)
            return frame

        for f in frames:
            for field, number, pos, left, right in zip(f["field"], f["number"], f["pos"], f["left"], f["right"], strict=True):
                unit, run = runs[field]
                row = (number, pos, _split(left, unit), _split(right, unit))
                if field != own or not node or _common(node[-1][3], row[3], run // 2) < run // 2:
                    yield from close()
                    own = field
                node.append(row)
        yield from close()
        for field in runs:
            yield flush(field)

    schema = "field string, number_a long, number_b long" if pairs else "field string, number long, start int, stop int"
    found = parts.mapInPandas(walk, schema)
    crowded = suffixes.where("hot").select("field", "number", "pos")
    if not crowded.isEmpty():
        found = found.unionByName(_crowded(records, crowded, runs, pairs, chunk))
    found = found.distinct()
    if pairs:
        return _with_copied_pairs(found, members) if copied else found
    if not copied:
        return found
    own = found.withColumnRenamed("number", "rep").join(members.select("field", "rep", "number"), ["field", "rep"]).select("field", "number", "start", "stop")
    whole = members.select("field", "number", F.lit(0).alias("start"), F.col("symbols").alias("stop"))
    alone = found.join(members.select("field", "number"), ["field", "number"], "left_anti")
    return own.unionByName(alone).unionByName(whole).distinct()


def _crowded(records: DataFrame, crowded: DataFrame, runs: dict[str, tuple[str, int]], pairs: bool, chunk: int) -> DataFrame:
    """Shared spans around the suffixes (field, number, pos) of k-grams that stand very often: every span that holds such a k-gram, by its digest."""

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for field, number, body, at in zip(f["field"], f["number"], f["body"], f["at"], strict=True):
                unit, run = runs[field]
                seq = _split(body, unit)
                starts = {p - o for p in at for o in range(run - run // 2 + 1) if 0 <= p - o <= len(seq) - run}
                for start in starts:
                    part = seq[start : start + run]
                    out.append((field, number, start, xxhash.xxh3_128_digest(part if unit == "char" else END.join(part))))
            yield pd.DataFrame(out, columns=["field", "number", "start", "span"])

    places = crowded.groupBy("field", "number").agg(F.collect_set("pos").alias("at"))
    spans = materialise(records.join(places, ["field", "number"]).mapInPandas(digests, "field string, number long, start int, span binary"), "p1-crowded")
    # one row of each span and record, so that equal records have equal sums; added up before the shuffle
    once = spans.select("field", "span", "number").distinct() if pairs else spans
    by = once.groupBy("field", "span").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("number").cast("decimal(38,0)")).alias("records")).where("lo < hi")
    if not pairs:
        own = spans.join(by.select("field", "span"), ["field", "span"])
        size = F.element_at(F.create_map(*[F.lit(x) for f, (_, run) in runs.items() for x in (f, run)]), F.col("field"))
        return own.select("field", "number", "start", (F.col("start") + size).alias("stop"))
    one = by.groupBy("field", "lo", "hi", "n", "records").agg(F.min("span").alias("span")).select("field", "span")
    own = once.join(one, ["field", "span"])
    return pairs_within(own, ["field", "span"], "number", "number_a", "number_b", chunk).select("field", "number_a", "number_b").distinct()


def _copies(records: DataFrame, runs: dict[str, tuple[str, int]]) -> DataFrame:
    """(field, rep, number, symbols) of the records, long enough for a span, whose body other keys have too; rep is the least of them."""
    size = F.lit(None).cast("int")
    long_enough = F.lit(False)
    for field, (unit, run) in runs.items():
        n = F.length("body") if unit == "char" else F.length("body") - F.length(F.replace("body", F.lit(END), F.lit("")))
        size = F.when(F.col("field") == field, n).otherwise(size)
        long_enough = long_enough | ((F.col("field") == field) & (n >= run))
    keys = materialise(records.where(long_enough).select("field", "number", F.sha2("body", 256).alias("h"), size.alias("symbols")), "p1-keys")
    classes = keys.groupBy("field", "h").agg(F.min("number").alias("rep"), F.max("number").alias("top")).where("rep < top").select("field", "h", "rep")
    copies = materialise(keys.join(classes, ["field", "h"]).select("field", "rep", "number", "symbols").distinct(), "p1-copies")
    discard(keys)
    return copies


def _with_copied_pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of representatives, of all their copies, and of copies of one body."""
    m = members.select("field", "rep", "number")
    a = found.join(m.select("field", F.col("rep").alias("number_a"), F.col("number").alias("x")), ["field", "number_a"], "left").select("field", F.coalesce("x", "number_a").alias("x"), "number_b")
    b = a.join(m.select("field", F.col("rep").alias("number_b"), F.col("number").alias("y")), ["field", "number_b"], "left").select("field", "x", F.coalesce("y", "number_b").alias("y"))
    within = pairs_within(m, ["field", "rep"], "number", "x", "y").select("field", "x", "y")
    return b.unionByName(within).select("field", F.least("x", "y").alias("number_a"), F.greatest("x", "y").alias("number_b"))


def _with_prefix(suffixes: DataFrame, runs: dict[str, tuple[str, int]], most: int) -> DataFrame:
    """Adds `prefix`: of the prefixes of 1, 2, 4, ... symbols, at most run/2, the first whose group has at most `most` suffixes."""
    longest = max(run // 2 for _, run in runs.values())
    size, rest, done = 1, suffixes, []
    while True:
        prefix = F.lit(None).cast("string")
        for field, (unit, run) in runs.items():
            n = min(size, run // 2)
            own = F.substring("right", 1, n) if unit == "char" else F.substring_index("right", END, n)
            prefix = F.when(F.col("field") == field, own).otherwise(prefix)
        here = rest.withColumn("prefix", prefix)
        if size >= longest:
            break
        large = materialise(here.groupBy("field", "prefix").count().where(F.col("count") > most).select("field", "prefix"), "p1-prefixes")
        if large.isEmpty():
            break
        done.append(here.join(large, ["field", "prefix"], "left_anti"))
        rest = here.join(large, ["field", "prefix"], "left_semi").drop("prefix")
        size *= 2
    for part in done:
        here = here.unionByName(part)
    return here

"""Records that share most of their words, by a byte-position inverted index with count filtering.

The similarity of two bags of words is their common words divided by their united words, both counted with
repetition; pairs that reach `least` (0.7) are found, wherever the words stand.

* A word's i-th occurrence is one token, so a bag is a set of tokens. Bags of equal tokens form a class; only one
  of each class is compared with others.
* Digest: bags of similar size share a size class; each class has a number of positions. A token falls on one
  position by its hash, and the digest holds there eight bytes that depend on all tokens of the position. One byte
  would make posting lists of 1/256 of all records; eight are tested at once and tell the same.
* Guarantee: bags of a and b tokens that reach the threshold differ in at most D = (a+b)(1-least)/(1+least) tokens,
  each of which changes one position. So all but D of a bag's positions are equal in both.
* Index: positions are ordered by the rarity of their content (from token counts in a table of fixed size). Two bags
  that agree on all but D positions share the `SHARED` first of their common positions within the D+`SHARED` rarest of each, so only
  these are posted. A position with a token that no other record has is counted but not posted.
* Bits: for every posting met by two records, a second digest of single bits is compared. Each differing token
  flips one bit, so bags within the threshold differ in at most D bits; of the others next to none pass.
* Count filter: shared positions are tallied per pair, and a pair needs the guaranteed minimum of `SHARED` (of very small bags, all positions but D).
* Verification: the common tokens are counted exactly (as 64-bit hashes of word and occurrence).

Posting lists that may hold more than `hot` records (known from the token counts) are cut into chunks, and each
pair of chunks is a group of its own. Nothing is capped or dropped.

Null keys and null or empty bags are left out (empty bags are similar to nothing); repeated deliveries of a key with
equal bags count once; ties don't arise; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.llm.pairs import pairs_within
from lexspace.storage import discard, materialise, ship_package

LEAST = (7, 10)
BINS = 1 << 21
HOT, CHUNK = 4096, 2048
SMALL = 64
SHARED = 2
_LOW = (1 << 32) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word -> hash, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens_of(bags_: list[list[str]], known: _Hashes) -> list[np.ndarray]:
    """Of each bag the sorted tokens (hash of word and occurrence)."""
    sizes = np.fromiter(map(len, bags_), np.int64, len(bags_))
    word = np.fromiter((known[w] for b in bags_ for w in b), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(bags_)), sizes)
    order = np.lexsort((word, owner))
    word = word[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])] if len(word) else np.zeros(0, bool)
    turn = np.arange(len(word)) - np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
    token = _mix(word + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return np.split(token[np.lexsort((token, owner))], np.cumsum(sizes)[:-1])


class Digests:
    """Digests of bags against a table of token counts."""

    def __init__(self, counts: np.ndarray, least: tuple[int, int]):
        self.counts, (self.num, self.den) = counts, least
        self.ratio = math.log(self.den / self.num)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return (np.log(n) / self.ratio + 1e-9).astype(np.int64)

    def upper(self, c: np.ndarray) -> np.ndarray:
        return np.exp(self.ratio * (c + 1))

    def most_different(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """D: tokens in which two bags of these sizes that reach the threshold differ at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def bits(self, t: np.ndarray, owner: np.ndarray, c: np.ndarray) -> pa.Array:
        """The second digest of each bag: the parity of the tokens on each bit. t: all tokens, owner: their bags, c: the bags' classes."""
        m = 64 * np.ceil(1.3 * self.upper(c) / 64).astype(np.int64)
        start = np.cumsum(m) - m
        at = start[owner] + (_mix(t ^ np.uint64(0xA5A5A5A5)) % m[owner].astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(at, minlength=int(m.sum())) & 1).astype(np.uint8))
        offsets = (np.r_[start, m.sum()] // 8).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])

    def postings(self, t: np.ndarray, owner: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bag, content hash, rank by rarity, most records that may have it) of the posted positions in each bag's class c, and each bag's number of positions."""
        upper = self.upper(c)
        places = np.where(upper < SMALL, 1 << 32, 2 * np.ceil(upper).astype(np.int64)).astype(np.uint64)
        mine = c.astype(np.uint64)
        place = _mix(t + mine[owner]) % places[owner]
        order = np.lexsort((place, owner))
        t, place, owner = t[order], place[order], owner[order]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
        bag = owner[first]
        content = _mix(np.add.reduceat(_mix(t), first) + place[first] * np.uint64(0x9E3779B97F4A7C15) + mine[bag])
        rare = np.minimum.reduceat(self.counts[(t % np.uint64(BINS)).astype(np.int64)], first)
        width = np.diff(np.r_[first, len(t)])
        order = np.lexsort((content, -width, rare, bag))
        bag, content, rare = bag[order], content[order], rare[order]
        rank = np.arange(len(bag)) - np.searchsorted(bag, bag)
        keep = (rank < self.most_different(n, n * self.den // self.num)[bag] + SHARED) & (rare > 1)
        return bag[keep], content[keep].view(np.int64), rank[keep], rare[keep], np.bincount(bag, minlength=len(n))


def bags(records: DataFrame, unit_of: dict[str, str]) -> DataFrame:
    """Of records (field, number, body): (field, number, n, bag, tokens). unit: "space" (white space divides words) or "token"."""
    from lexspace.llm.spans import END

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for f in frames:
            if len(known) > 1_000_000:
                known.clear()
            got = tokens_of([body.split() if unit_of[field] == "space" else body.split(END)[:-1] for field, body in zip(f["field"], f["body"], strict=True)], known)
            yield pd.DataFrame({"field": f["field"], "number": f["number"], "n": [len(t) for t in got], "bag": [xxhash.xxh3_128_digest(t.tobytes()) for t in got], "tokens": got})

    clean = records.select("field", F.col("number").cast("long").alias("number"), "body").where("field is not null and number is not null and body is not null")
    return clean.mapInPandas(run, "field string, number long, n int, bag binary, tokens array<long>").where("n > 0")


def _pairs(batches: Iterator[pa.RecordBatch], d: Digests) -> Iterator[pa.RecordBatch]:
    """Pairs of records that meet in a posting and pass the filters; rows come sorted by key."""
    rest = None
    for b in batches:
        rest = b if rest is None else pa.concat_batches([rest, b])
        key = rest.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut and rest.num_rows >= 20_000:
            yield from _complete(rest.slice(0, cut), d)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield from _complete(rest, d)


def _complete(b: pa.RecordBatch, d: Digests) -> Iterator[pa.RecordBatch]:
    key, number, sizes, places, cell = (b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "number", "sizes", "places", "cell"))
    n, rank, held, own, field = sizes >> 32, sizes & _LOW, places >> 32, (places & 1).astype(bool), places >> 1 & 255
    bits = b.column("bits")
    offsets, raw = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1], np.frombuffer(bits.buffers()[2] or b"", np.uint8)
    got_a, got_b, got_need = [], [], []
    at, step = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        i, j = at, at + step
        most = d.most_different(n[i], n[j])
        ok = (number[i] != number[j]) & (rank[i] < most + SHARED) & (rank[j] < most + SHARED) & (own[i] | own[j]) & (np.minimum(n[i], n[j]) * d.den >= np.maximum(n[i], n[j]) * d.num) & ((cell[i] & 1 == 0) | (cell[i] != cell[j]))
        i, j, most = i[ok], j[ok], most[ok]
        for s in range(0, len(i), 1 << 15):
            x, y, m = i[s : s + (1 << 15)], j[s : s + (1 << 15)], most[s : s + (1 << 15)]
            width = offsets[x + 1] - offsets[x]
            for w in np.unique(width):
                own_w = np.flatnonzero(width == w)
                grid = np.arange(w)
                differ = raw[offsets[x[own_w]][:, None] + grid] ^ raw[offsets[y[own_w]][:, None] + grid]
                near = own_w[np.bitwise_count(differ.view(np.uint64)).sum(axis=1) <= m[own_w]]
                got_a.append(x[near])
                got_b.append(y[near])
                got_need.append(np.clip(np.maximum(held[x[near]], held[y[near]]) - m[near], 1, SHARED))
        step += 1
    if got_a:
        x, y = np.concatenate(got_a), np.concatenate(got_b)
        lo, hi = np.minimum(number[x], number[y]), np.maximum(number[x], number[y])
        yield pa.RecordBatch.from_arrays([pa.array(field[x], pa.int32()), pa.array(lo), pa.array(hi), pa.array(np.concatenate(got_need), pa.int32())], names=["f", "a", "b", "need"])


def similar_pairs(records: DataFrame, unit_of: dict[str, str], least: tuple[int, int] = LEAST, hot: int = HOT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives: field, a, b, common, united; membership: field, rep, number).

    records: field string, number long, body string; least: the threshold as a fraction (numerator, denominator).
    """
    spark = records.sparkSession
    ship_package(spark)
    every = materialise(bags(records, unit_of).withColumn("row", F.monotonically_increasing_id()), "p6-bags")
    classes = every.groupBy("field", "bag").agg(F.min(F.struct("number", "row")).alias("r"))
    members = materialise(every.join(classes, ["field", "bag"]).select("field", F.col("r.number").alias("rep"), "number").distinct(), "p6-members")
    # one row of each representative: only row numbers are grouped, the tokens are moved once at most
    chosen = classes.groupBy("field", "r.number").agg(F.min("r.row").alias("row")).select("row")
    reps = materialise(every.join(chosen, "row", "left_semi").select("field", "number", "n", "tokens"), "p6-reps")
    discard(every)
    bins = reps.select(F.explode("tokens").alias("t")).groupBy(F.expr(f"t & {BINS - 1}").cast("int").alias("bin")).count().where("count > 1").toPandas()  # at most BINS rows
    counts = np.ones(BINS, np.int32)
    counts[bins["bin"].to_numpy()] = np.minimum(bins["count"].to_numpy(), 2**31 - 1)
    shared = spark.sparkContext.broadcast(Digests(counts, least))
    fields = sorted(unit_of)
    # sizes: tokens and rank; places: positions, field and whether the class is the record's own; cell: chunk and whether the group is of two chunks
    schema = "key long, number long, sizes long, places long, cell int, bits binary"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                number, n = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
                t = b.column(3).flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(n)), n)
                names = b.column(0).to_pylist()
                salt = np.array([xxhash.xxh3_64_intdigest(f) >> 1 for f in names], np.int64)
                number_of_field = np.array([fields.index(f) for f in names], np.int64)
                own = d.size_class(n)
                for c in (own, own + 1):
                    bag, key, rank, most, held = d.postings(t, owner, n, c)
                    key = key ^ salt[bag]
                    parts = np.where(most > hot, -(-most // chunk), 1)
                    mine = (_mix(number[bag].view(np.uint64)) >> np.uint64(34)).astype(np.int64) % parts
                    cross = np.zeros(len(key), bool)
                    if (parts > 1).any():  # a posting for each pair of chunks
                        at = np.repeat(np.arange(len(key)), parts)
                        other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                        first, second = np.minimum(mine[at], other), np.maximum(mine[at], other)
                        salted = _mix(key[at].view(np.uint64) + first.astype(np.uint64) * np.uint64(1_000_003) + second.astype(np.uint64)).view(np.int64)
                        bag, key, rank, mine, cross = bag[at], np.where(parts[at] > 1, salted, key[at]), rank[at], mine[at], first != second
                    places = held << 32 | number_of_field << 1 | (c == own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(number[bag]), pa.array(n[bag] << 32 | rank), pa.array(places[bag]), pa.array(mine * 2 + cross, pa.int32()), d.bits(t, owner, c).take(pa.array(bag))],
                        names=["key", "number", "sizes", "places", "cell", "bits"],
                    )

    posted = reps.select("field", "number", "n", "tokens").mapInArrow(post, schema)
    met = posted.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _pairs(b, shared.value), "f int, a long, b long, need int")
    tally = met.groupBy("f", "a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need")
    named = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("f") + 1)
    tally = materialise(tally.select(named.alias("field"), "a", "b"), "p6-tally")
    left, right = (reps.select("field", F.col("number").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    both = tally.join(left, ["field", "a"]).join(right, ["field", "b"])
    common = both.select("field", "a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"), (F.size("tokens_a") + F.size("tokens_b")).alias("sum"))
    found = common.select("field", "a", "b", "common", (F.col("sum") - F.col("common")).alias("united")).where(F.col("common") * least[1] >= F.col("united") * least[0])
    pairs = materialise(found, "p6-pairs")
    for done in (reps, tally):
        discard(done)
    return pairs, members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(field, number_a, number_b): all pairs of keys, copies of the representatives included."""
    a, b = members.select("field", F.col("rep").alias("a"), F.col("number").alias("x")), members.select("field", F.col("rep").alias("b"), F.col("number").alias("y"))
    across = pairs.select("field", "a", "b").join(a, ["field", "a"]).join(b, ["field", "b"]).select("field", "x", "y")
    within = pairs_within(members, ["field", "rep"], "number", "x", "y").select("field", "x", "y")
    return across.unionByName(within).select("field", F.least("x", "y").alias("number_a"), F.greatest("x", "y").alias("number_b"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(field, number, class_id, links, group_id): a key's class of equal bags, the number of similar other classes, and the least key that is reached over similar pairs."""
    links = pairs.select("field", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("field", "e.v", "e.w")
    label = materialise(links.groupBy("field", "v").agg(F.least(F.col("v"), F.min("w")).alias("g")), "p6-label")
    while True:
        near = links.join(label.select("field", F.col("v").alias("w"), "g"), ["field", "w"]).groupBy("field", "v").agg(F.min("g").alias("m"))
        hop = label.join(near, ["field", "v"]).select("field", "v", F.col("g").alias("old"), F.least("g", "m").alias("p"))
        jump = hop.join(label.select("field", F.col("v").alias("p"), F.col("g").alias("q")), ["field", "p"], "left").select("field", "v", "old", F.least("p", F.coalesce("q", "p")).alias("g"))
        new = materialise(jump, "p6-label")
        changed = new.where("g <> old").limit(1).count()
        discard(label)
        label = new.select("field", "v", "g")
        if not changed:
            break
    degree = links.groupBy("field", F.col("v").alias("rep")).agg(F.count("*").alias("links"))
    named = members.join(degree, ["field", "rep"], "left").join(label.select("field", F.col("v").alias("rep"), "g"), ["field", "rep"], "left")
    return named.select("field", "number", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("g", "rep").alias("group_id"))

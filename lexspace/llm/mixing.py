"""A collection in which each source has its target share of the tokens.

* Tokenise and pack: in one map stage the texts of each source are tokenised by a public tokenizer and packed
  into blocks of `block_tokens` tokens; what a task has left over of a source (less than a block) is packed together in a second,
  small stage. A block knows its documents and the tokens of each.
* Size: with T tokens of a source, at most `max_repeats` uses of each and a share p of those sources that
  can be drawn from, the collection has min(max_repeats * T / p) tokens, the largest in which every share is reached; or
  fewer, as asked for. Quotas are in tokens: the last block drawn from a source is cut to what is left of its quota, so a share is met to
  within a token, however small the source is against a block.
* Draw: output shards get multinomial counts of the sources' blocks, with probabilities that follow what each source
  still has to give, so the totals are met exactly and no source exceeds its repeats.
* Permute: the slots of a source go to its blocks through pseudorandom permutations of the block index, one for each
  repeat (a keyed Feistel network with cycle walking). The permutation is inverted at the block, which gives
  the block's slots and shards without moving any tokens: the join by index needs no shuffle.

A repeat of a source begins only when all its blocks have been used as often, so a document is repeated at most max_repeats times.
The tokenizer's file is sent to the executors, which need no copy of it.

Source names are compared without case and outer space, with - as _. Null or empty texts have no tokens; documents of a null
or unlisted source are not drawn; a source with a null, negative or zero share, no repeats or no documents gives nothing and
the other shares are scaled up to 1; of a source listed twice the larger share counts; without any source that can be drawn from the result is empty. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspace.storage import materialise, ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK_TOKENS = 1024
SHARDS = 64
SEED = 9
BLOCK_SCHEMA = "source string, n_tokens int, tokens array<int>, docs array<struct<doc_id:long,start:int,n:int>>, seq int"
_ARROW = pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def plain_source(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))


def published_pattern() -> str:
    """The pattern that the public rank files are published with; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_tokenizer(vocabulary: str, pattern: str):
    """The tokenizer of a rank file and its pattern."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Token streams of sources, cut into blocks."""

    def __init__(self, size: int):
        self.size, self.open = size, {}
        self.made: dict[str, int] = {}
        self.out: list[tuple] = []

    def add(self, source: str, doc_id: int, start: int, tokens: list[int]) -> None:
        held, docs = self.open.setdefault(source, ([], []))
        at = 0
        while at < len(tokens):
            n = min(self.size - len(held), len(tokens) - at)
            held.extend(tokens[at : at + n])
            docs.append({"doc_id": doc_id, "start": start + at, "n": n})
            at += n
            if len(held) == self.size:
                self._emit(source, held[:], docs[:])
                held.clear()
                docs.clear()

    def _emit(self, source: str, tokens: list[int], docs: list[dict]) -> None:
        self.out.append((source, len(tokens), tokens, docs, self.made.setdefault(source, 0)))
        self.made[source] += 1

    def rest(self) -> None:
        for source, (held, docs) in self.open.items():
            if held:
                self._emit(source, held, docs)
        self.open = {}

    def batch(self) -> pa.RecordBatch:
        source, n, tokens, docs, seq = zip(*self.out, strict=True) if self.out else ([], [], [], [], [])
        self.out = []
        arrays = [pa.array(source, pa.string()), pa.array(n, pa.int32()), pa.array(tokens, pa.list_(pa.int32())), pa.array(docs, pa.list_(_ARROW)), pa.array(seq, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["source", "n_tokens", "tokens", "docs", "seq"])


def token_blocks(documents: DataFrame, sources: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the documents (doc_id, source, text) of `sources` (source): source, part, seq (0.. in each source and part), n_tokens, tokens, docs. At most one block of a source isn't full."""
    spark = documents.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(vocabulary)
    name, pattern = os.path.basename(vocabulary), published_pattern()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = load_tokenizer(SparkFiles.get(name), pattern), Packer(block_tokens)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                for doc_id, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    packer.add(source, doc_id, 0, tokenizer.encode_ordinary(text))
                yield packer.batch()
        packer.rest()
        yield packer.batch()

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(block_tokens)
        for b in batches:
            for source, tokens, docs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                at = 0
                for d in docs:
                    packer.add(source, d["doc_id"], d["start"], tokens[at : at + d["n"]])
                    at += d["n"]
            yield packer.batch()
        packer.rest()
        yield packer.batch()

    own = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where("doc_id is not null and text != ''")
    own = own.join(F.broadcast(sources.select("source").distinct()), "source", "left_semi").select("doc_id", "source", "text")
    first = materialise(own.mapInArrow(pack, BLOCK_SCHEMA).withColumn("part", F.spark_partition_id()), "p9-blocks")
    whole = first.where(F.col("n_tokens") == block_tokens)
    pieces = first.where(F.col("n_tokens") < block_tokens).select("source", "n_tokens", "tokens", "docs").repartition("source").sortWithinPartitions("source")
    rest = materialise(pieces.mapInArrow(repack, BLOCK_SCHEMA).withColumn("part", -1 - F.spark_partition_id()), "p9-rest")
    return whole.unionByName(rest)


def _feistel(x: np.ndarray, bits: int, key: int, inverse: bool) -> np.ndarray:
    half = np.uint64(bits // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for r in reversed(range(6)) if inverse else range(6):
        if inverse:
            left, right = right ^ (_round(left, key, r) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, r) & mask)
    return left << half | right


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or its inverse, at x."""
    bits = max(2, 2 * math.ceil(max(1, (n - 1).bit_length()) / 2))
    out = _feistel(np.asarray(x, np.uint64), bits, key, inverse)
    while (over := out >= n).any():
        out[over] = _feistel(out[over], bits, key, inverse)
    return out.astype(np.int64)


def quotas(tokens: dict[str, int], weights: dict[str, tuple[float | None, int | None]], total: int | None = None) -> dict[str, int]:
    """Tokens to draw from each source, at least one: shares of the largest total within all repeats, or of `total` if that is less."""
    can = {s: p for s, (p, r) in weights.items() if p and p > 0 and r and r > 0 and tokens.get(s)}
    if not can:
        return {}
    scale = sum(can.values())
    largest = min(weights[s][1] * tokens[s] * scale / p for s, p in can.items())
    size = min(largest, total) if total else largest
    return {s: max(1, min(round(size * p / scale), weights[s][1] * tokens[s])) for s, p in can.items()}


def last_slot(quota: int, blocks: int, tokens: int, block_tokens: int, short: tuple[int, int] | None, place) -> tuple[int, int]:
    """(slots, tokens of the last slot's block) that give `quota` tokens of a source.

    short: index and length of the block that isn't full, if there is one; place(repeat, index): a block's slot in a repeat.
    """
    repeats, rest = divmod(quota, tokens)
    if not rest:
        repeats, rest = repeats - 1, tokens
    z = place(repeats, short[0]) if short else blocks
    lack = block_tokens - short[1] if short else 0

    def given(c: int) -> int:
        return c * block_tokens - (lack if z < c else 0)

    c = -(-rest // block_tokens)
    c += given(c) < rest
    return repeats * blocks + c, rest - given(c - 1)


def shard_counts(quota: dict[str, int], shards: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Of each source the drawn blocks of each shard: multinomial counts whose probabilities follow what is left to draw."""
    names = sorted(quota)
    left = np.array([quota[s] for s in names], np.int64)
    rng, rows = np.random.default_rng(seed), []
    for k in range(shards):
        size = int(left.sum()) // (shards - k)
        count = np.zeros(len(names), np.int64)
        while (missing := size - int(count.sum())) > 0:
            room = left - count
            count += np.minimum(rng.multinomial(missing, room / room.sum()), room)
        left -= count
        rows.append(count)
    return {s: np.array(rows)[:, i] for i, s in enumerate(names)} if rows else {}


def mixture(
    documents: DataFrame,
    weights: DataFrame,
    total_tokens: int | None = None,
    vocabulary: str = VOCABULARY,
    block_tokens: int = BLOCK_TOKENS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """The drawn blocks: shard int, source string, slot long, repeat int, block long, n_tokens int, tokens, docs.

    documents: doc_id, source, text. weights: source, target_share, max_repeats (collected: one row for each source).
    """
    spark = documents.sparkSession
    weights = weights.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    given = {r.source: (r.target_share, r.max_repeats) for r in weights.orderBy(F.col("target_share").asc_nulls_first()).collect()}
    blocks = token_blocks(documents, weights, vocabulary, block_tokens)
    parts = blocks.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).toPandas()  # sources x tasks rows of a few bytes
    number: dict[str, int] = {}
    held: dict[str, int] = {}
    start: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for s, own in parts.sort_values(["source", "part"]).groupby("source"):
        n = own["n"].to_numpy(np.int64)
        start[s], number[s], held[s] = (own["part"].to_numpy(), np.cumsum(n) - n), int(n.sum()), int(own["t"].sum())
    short = {}
    for r in blocks.where(F.col("n_tokens") < block_tokens).select("source", "part", "seq", "n_tokens").collect():  # at most one of each source
        at, first = start[r.source]
        short[r.source] = int(first[np.searchsorted(at, r.part)]) + r.seq, r.n_tokens
    keys = {s: i for i, s in enumerate(sorted(number))}

    def cipher(s: str, e: int) -> int:
        return (seed * 1_000_003 + keys[s]) * 1009 + e

    quota, cut = {}, {}
    for s, x in quotas(held, given, total_tokens).items():
        place = lambda e, i, s=s: int(permuted(np.array([i]), number[s], cipher(s, e), inverse=True)[0])
        quota[s], cut[s] = last_slot(x, number[s], held[s], block_tokens, short.get(s), place)
    ends = {s: np.cumsum(c) for s, c in shard_counts(quota, shards, seed).items()}
    plan = spark.sparkContext.broadcast((number, start, quota, cut, ends))
    schema = "shard int, source string, slot long, repeat int, block long, n_tokens int, tokens array<int>, docs array<struct<doc_id:long,start:int,n:int>>"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, start, quota, cut, ends = plan.value
        names_out = ["shard", "source", "slot", "repeat", "block", "n_tokens", "tokens", "docs"]
        for b in batches:
            block, part = b.column(5).to_numpy().astype(np.int64), b.column(4).to_numpy()
            names, rows = np.array(b.column(0).to_pylist(), object), []
            for s in set(names.tolist()):
                own = np.flatnonzero(names == s)
                block[own] += start[s][1][np.searchsorted(start[s][0], part[own])]
                n, c = number[s], quota.get(s, 0)
                for e in range(-(-c // n)):
                    slot = permuted(block[own], n, cipher(s, e), inverse=True) + e * n
                    hit = np.flatnonzero(slot < c)
                    rows.append((own[hit], slot[hit], np.full(len(hit), e), np.searchsorted(ends[s], slot[hit], side="right"), slot[hit] == c - 1))
            if not rows:
                continue
            at, slot, repeat, shard, last = (np.concatenate(x) for x in zip(*rows, strict=True))
            for own in (np.flatnonzero(~last), *np.flatnonzero(last)[:, None]):  # a source's last block goes by itself, cut to the quota
                took = b.take(pa.array(at[own]))
                columns = [took.column(i) for i in (1, 2, 3)]
                if len(own) == 1 and last[own[0]]:
                    columns = _first_tokens(columns, cut[took.column(0)[0].as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(shard[own], pa.int32()), took.column(0), pa.array(slot[own]), pa.array(repeat[own], pa.int32()), pa.array(block[at[own]]), *columns], names=names_out)

    return blocks.select("source", "n_tokens", "tokens", "docs", "part", "seq").mapInArrow(draw, schema)


def _first_tokens(columns: list[pa.Array], n: int) -> list[pa.Array]:
    """One block (n_tokens, tokens, docs) cut to its first n tokens."""
    docs, left = [], n
    for d in columns[2][0].as_py():
        if left > 0:
            docs.append(d | {"n": min(d["n"], left)})
            left -= d["n"]
    return [pa.array([n], pa.int32()), pa.array([columns[1][0].as_py()[:n]], columns[1].type), pa.array([docs], columns[2].type)]


def reached_shares(drawn: DataFrame, weights: DataFrame) -> DataFrame:
    """Of each listed source: target_share, scaled_share (of those that can be drawn from), reached_share, deviation (of the one from the other), tokens, blocks, most_repeats."""
    weights = weights.select(plain_source(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    by = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("blocks"), (F.max("repeat") + 1).alias("most_repeats"))
    both = weights.join(by, "source", "left").fillna(0, ["tokens", "blocks", "most_repeats"])
    sums = both.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("all_shares"))
    scaled = F.when(F.col("tokens") > 0, F.col("target_share") / F.col("all_shares")).otherwise(F.lit(0.0))
    reached = F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0))
    every = both.crossJoin(F.broadcast(sums))  # one row
    return every.select("source", "target_share", scaled.alias("scaled_share"), reached.alias("reached_share"), (reached - scaled).alias("deviation"), "tokens", "blocks", "most_repeats")

"""Properties of the building blocks on generated inputs."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspace.llm import collision, mixing, neardup, spans
from lexspace.llm.folding import fold_words

few = settings(max_examples=60, deadline=None)
seq = st.lists(st.integers(0, 3), max_size=40)


@few
@given(seq, seq, seq, seq, st.lists(st.integers(0, 2), min_size=12, max_size=30))
def test_equal_spans_sample_equal_places(a, b, c, d, shared):
    one, two = np.array([*a, *shared, *b], np.uint64), np.array([*c, *shared, *d], np.uint64)
    x, y = (set((spans.anchors(s, 12)[0] - start).tolist()) for s, start in ((one, len(a)), (two, len(c))))
    assert any(0 <= p <= len(shared) - 6 for p in x & y)


@few
@given(st.integers(1, 5000), st.integers(0, 2**40))
def test_permutations(n, key):
    x = np.arange(n)
    y = mixing.permuted(x, n, key)
    assert len(np.unique(y)) == n and y.min() == 0 and y.max() == n - 1
    assert (mixing.permuted(y, n, key, inverse=True) == x).all()


@few
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 40), max_size=6), st.integers(1, 9))
def test_shards_hold_what_is_drawn(quota, shards):
    counts = mixing.shard_counts(quota, shards)
    assert {s: int(c.sum()) for s, c in counts.items()} == quota and all((c >= 0).all() for c in counts.values())


@few
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=12), min_size=1, max_size=5))
def test_common_tokens_are_common_words_with_repetition(bags):
    tokens = neardup.tokens_of(bags, neardup._Hashes())
    assert [len(t) for t in tokens] == [len(b) for b in bags]
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            assert len(set(tokens[i].tolist()) & set(tokens[j].tolist())) == (Counter(a) & Counter(b)).total()


@few
@given(st.lists(st.integers(0, 60), min_size=2, max_size=60), st.lists(st.integers(0, 60), max_size=9), st.data())
def test_differing_tokens_change_so_many_positions_and_bits(words, added, data):
    gone = data.draw(st.integers(0, min(4, len(words) - 1)))
    bags = [[str(w) for w in words], [str(w) for w in [*words[gone:], *added]]]
    tokens = neardup.tokens_of(bags, neardup._Hashes())
    differ = len(set(tokens[0].tolist()) ^ set(tokens[1].tolist()))
    d = neardup.Digests(np.full(neardup.BINS, 2, np.int32), (7, 10))
    n, c = np.array([len(t) for t in tokens]), np.array([9, 9])
    flat, owner = np.concatenate(tokens).view(np.uint64), np.repeat([0, 1], n)
    bits = [np.frombuffer(b, np.uint8) for b in d.bits(flat, owner, c).to_pylist()]
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= differ
    bag, content, _, _, _ = d.postings(flat, owner, n * 1000, c)  # all positions
    a, b = (set(content[bag == i].tolist()) for i in (0, 1))
    assert len(a - b) <= differ and len(b - a) <= differ


@few
@given(st.text(alphabet="aBé־אְ­ _1\r\nßİ", max_size=30))
def test_folding_is_stable(text):
    words = fold_words(text)
    assert fold_words(" ".join(words)) == words == fold_words(text.replace("\n", "\r\n"))


def test_collisions_find_what_is_near():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:200] + 0.2 * rng.standard_normal((200, 64)).astype(np.float32) / 8
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    line = (x @ collision.directions(64, 64)).T.astype(np.float16)
    placed = line.argsort(axis=1)
    open_ = np.full(200, -2, np.float32)
    for level in collision.LEVELS:
        q = collision.Queries(np.arange(10_000, 10_200), near, np.full(200, level[0]), open_, 1, level, 64, 64)
        number, key, _ = q.in_block(np.arange(3000), x, placed, np.take_along_axis(line, placed, axis=1), open_)
        found = dict(zip(number.tolist(), key.tolist(), strict=True))
        assert np.mean([found.get(i) == i for i in range(200)]) > 0.97

"""The operators on texts against straight definitions, with dirty and skewed rows."""

import os
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from lexspace.llm import langid, leakage, mixing
from lexspace.llm.folding import fold_words

DOCS = "doc_id long, text string, lang string, source string, item_id int, passage string, tokens int, field string"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 1, "clash", 2, "x") for r in rows], DOCS)


# --- leakage ----------------------------------------------------------------------------------------------------


def slow_words(text):
    out, word = [], ""
    for ch in unicodedata.normalize("NFKD", text.casefold()):
        kind = unicodedata.category(ch)
        if kind[0] == "M" or kind == "Cf":
            continue
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def test_words():
    text = "Déjà-VU­x ‏שָׁל֑וֹם־עולם\r\nSTRASSE straße a_b 12,5 ét͏é"
    assert fold_words(text) == slow_words(text) == ["deja", "vux", "שלום", "עולם", "strasse", "strasse", "a", "b", "12", "5", "ete"]
    assert fold_words(None) == fold_words("") == []


def brute_leaks(rows, items, run=12):
    runs = {}
    for i, p in items:
        w = slow_words(p or "")
        for k in range(len(w) - run + 1):
            runs.setdefault(tuple(w[k : k + run]), set()).add(i)
    found = set()
    for d, t in rows:
        w = slow_words(t or "")
        if d is not None:
            for k in range(len(w) - run + 1):
                found |= {(d, i) for i in runs.get(tuple(w[k : k + run]), ()) if i is not None}
    return found


@pytest.mark.parametrize("per_pass", [2000, 3])
def test_leaked_items(spark, per_pass):
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(60)] + ["é", "שָׁלוֹם"]
    passages = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate((11, 12, 13, 20, 30, 45, 60, 40))]
    passages += [(20, "same " * 30), (21, "a b " * 20), (22, passages[5][1]), (23, None), (24, ""), (None, passages[5][1])]
    rows = [(None, passages[5][1]), (1, None), (2, ""), (3, "same " * 11), (4, "same " * 12), (5, "a b " * 9)]
    for k in range(10, 90):
        p = (passages[k % 8][1]).split()
        a = rng.randint(0, max(0, len(p) - 10))
        part = p[a : a + rng.choice((11, 12, 13, 25, 60))]
        filler = rng.choices(vocab, k=rng.choice((0, 1, 5, 24, 200)))
        at = rng.randint(0, len(filler))
        text = [*filler[:at], *part, *filler[at:]]
        rows.append((k, rng.choice((" ", "\r\n", " — ", ", "))[:1].join(w.upper() if k % 2 else w for w in text)))
    rows.append((99, " ".join(rng.choices(vocab, k=60_000)) + " " + passages[6][1]))
    rows.append(rows[-1])
    items = spark.createDataFrame([(i, p, "q") for i, p in passages], "item_id int, passage string, doc_id string")
    got = leakage.leaked_items(docs(spark, rows), items, items_per_pass=per_pass).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(rows, passages)
    whole = next(r for r in got if (r.doc_id, r.item_id) == (99, 6))
    assert (whole.longest_run, whole.words_covered, whole.passage_words) == (60, 60, 60)


def test_leaks_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a " * 20)], "item_id int, passage string")
    assert leakage.leaked_items(docs(spark, [(1, "a " * 20)]).limit(0), items).count() == 0
    assert leakage.leaked_items(docs(spark, [(1, "a " * 20)]), items.limit(0)).count() == 0


# --- languages --------------------------------------------------------------------------------------------------

LEXICON = {
    "en": "the of and that which through against shepherd margin psalm voice almost under keeps reading line where".split(),
    "de": "der die das und nicht durch gegen Hirte Rand Psalm Stimme beinahe unter bewahrt Lesung Zeile während über".split(),
    "fr": "le la les et qui dans contre berger marge psaume voix presque sous garde lecture ligne où très déjà".split(),
    "he": "את של על המזמור הקול כמעט תחת שומר השורה הקריאה אשר לא כי הרועה השוליים".split(),
    "es": "el los las y que por contra pastor margen salmo voz casi bajo guarda lectura renglón donde también".split(),
}


def speech(rng, lang, n=12):
    return " ".join(rng.choices(LEXICON[lang], k=n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    rows = []
    for i in range(250):
        code = list(LEXICON)[i % 5]
        label = code if i % 17 else "fr"  # some labels are wrong
        rows.append((label, "\n".join(speech(rng, code) for _ in range(4))))
    return rows


def test_held_out_accuracy(labelled):
    rng = random.Random(3)
    model = langid.fit(rng.sample(labelled, len(labelled)))
    truth = [c for c in LEXICON for _ in range(60)]
    texts = [speech(rng, c, 7) + " «" + speech(rng, "he", 3) + "»" if c != "he" else speech(rng, c, 7) for c in truth]
    _, _, best, confidence, _, rejected = model.classify([t.upper() if i % 2 else t for i, t in enumerate(texts)])
    assert np.mean([model.languages[b] == c for b, c in zip(best, truth, strict=True)]) > 0.98
    assert (confidence > 0).all() and (confidence <= 1).all() and rejected.mean() < 0.05
    assert model.classify(["хлеб вода земля небо огонь"])[5].all()


def test_probabilities_add_up():
    models = langid.KneserNey([{"abba": 3.0, "ab": 1.0}, {"xyx": 2.0}])
    letters = "abxy"
    for context in ("", "a", "ab", "xy"):
        p = np.zeros(2)
        for c in [*letters, ""]:
            word = context + c
            cost, _ = models.cost([word])
            before = np.zeros(2)
            if context and c:
                before = _prefix(models, context)
            if c:
                p += np.exp(-(_prefix(models, word) - before))
                if c == "a":  # all letters that no word has
                    p += np.exp(-(_prefix(models, context + "q") - before)) * (langid.ALPHABET - 5)
            else:
                p += np.exp(-(cost[0] - (_prefix(models, context) if context else 0)))
        assert p == pytest.approx([1, 1], abs=1e-4)


def _prefix(models, word):
    """Nats of a word's letters without its end."""
    owner, grams, contexts = langid._grams([word], models.order)
    p = np.full((len(owner), models.n), 1 / langid.ALPHABET)
    for n in range(models.order):
        at, hit = langid._find(models.contexts[n], contexts[n])
        p[hit] *= models.back[n][at[hit]]
        at, hit = langid._find(models.grams[n], grams[n])
        p[hit] += models.p[n][at[hit]]
    return -np.log(p[:-1]).sum(axis=0)


def test_wrong_and_mixed_documents(spark, labelled):
    rng = random.Random(4)
    rows = [(i, t, code) for i, (code, t) in enumerate(labelled)]
    rows += [
        (1001, speech(rng, "de") + "\n" + speech(rng, "fr") + "\r\nkurz und gut\n", "de"),
        (1002, speech(rng, "es"), None),
        (1003, speech(rng, "es"), "es-MX"),
        (1004, speech(rng, "he"), "iw"),
        (1005, speech(rng, "en"), "English"),
        (1006, speech(rng, "en"), "ger"),
        (1007, "zu wenig Wörter", "fr"),
        (1008, None, "fr"),
        (1009, "", "fr"),
        (1010, "1 2 3 4 5 6 7 — — a b c d", None),
        (None, speech(rng, "de"), "fr"),
        (1011, " ".join(LEXICON["de"][:6]), "xx"),
        (1012, (speech(rng, "fr") + " ") * 3000, "fra"),
    ]
    got = {}
    for r in langid.language_lines(docs(spark, rows + rows[-1:]), only_wrong=True).collect():
        got.setdefault(r.doc_id, {})[r.line_no] = r.lang
    assert {d: v for d, v in got.items() if d > 1000} == {1001: {0: "de", 1: "fr"}, 1002: {0: "es"}, 1006: {0: "en"}, 1011: {0: "de"}}
    wrong = {i for i in range(250) if i % 17 == 0 and list(LEXICON)[i % 5] != "fr"}
    assert {d for d in got if d < 1000} == wrong


def test_without_labels_there_is_no_model(spark):
    rows = [(1, "one two three four five six", None)]
    assert langid.language_lines(docs(spark, rows)).count() == 0
    assert langid.language_lines(docs(spark, rows).limit(0)).count() == 0


# --- mixtures ---------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="needs the public vocabulary")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutations_and_their_inverse(n):
    x = np.arange(n)
    y = mixing.permuted(x, n, 5)
    assert sorted(y.tolist()) == x.tolist() and (mixing.permuted(y, n, 5, inverse=True) == x).all()
    assert n < 10 or (mixing.permuted(x, n, 6) != y).any()


def test_quotas():
    weights = {"a": (0.5, 1), "b": (0.25, 4), "c": (0.25, 1), "none": (None, 3), "lost": (0.5, 2), "nil": (0.0, 2), "never": (0.3, 0)}
    tokens = {"a": 100, "b": 20, "c": 80, "none": 7, "nil": 3, "never": 9}
    assert mixing.quotas(tokens, weights) == {"a": 100, "b": 50, "c": 50}
    assert mixing.quotas(tokens, weights, total=40) == {"a": 20, "b": 10, "c": 10}
    assert mixing.quotas({}, weights) == {} and mixing.quotas(tokens, weights, total=8) == {"a": 4, "b": 2, "c": 2}
    assert mixing.quotas({"a": 10**6, "b": 3}, {"a": (0.999999, 1), "b": (1e-9, 1)})["b"] == 1


@pytest.mark.parametrize(("blocks", "short"), [(1, (0, 3)), (1, None), (5, (0, 1)), (5, (4, 9)), (7, (3, 5)), (6, None)])
def test_the_last_slot_gives_exactly_the_quota(blocks, short):
    size = 10
    sizes = [size] * blocks
    if short:
        sizes[short[0]] = short[1]
    place = lambda e, i: int(mixing.permuted(np.array([i]), blocks, e, inverse=True)[0])
    for quota in range(1, 3 * sum(sizes) + 1):
        slots, cut = mixing.last_slot(quota, blocks, sum(sizes), size, short, place)
        drawn = [sizes[int(mixing.permuted(np.array([k % blocks]), blocks, k // blocks)[0])] for k in range(slots)]
        assert sum(drawn[:-1]) + cut == quota and 0 < cut <= drawn[-1]


def test_shards_meet_the_quotas():
    quota = {"a": 100, "b": 50, "c": 3}
    counts = mixing.shard_counts(quota, 8)
    assert {s: int(c.sum()) for s, c in counts.items()} == quota
    sizes = sum(counts.values())
    assert sizes.max() - sizes.min() <= 1 and (sizes >= 0).all()


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(5)
    rows = [(None, "a b", None, "big"), (1, None, None, "big"), (2, "", None, "big"), (3, "not listed", None, "other"), (4, "no source", None, None)]
    names = ["big", " Big", "BIG", "small", "tiny-one", "tiny_one"]
    for k in range(10, 400):
        rows.append((k, " ".join(rng.choices(["alpha", "beta", "gamma", "שלום"], k=rng.randint(1, 60))), None, names[k % 6] if k % 5 else "big"))
    weights = spark.createDataFrame([("big", 0.5, 2, "x"), ("small", 0.3, 5, "x"), ("tiny_one", 0.2, 3, "x"), ("lost", 0.4, 2, "x"), ("nothing", None, 2, "x"), (None, 0.1, 1, "x")], "source string, target_share double, max_repeats int, text string")
    drawn = mixing.mixture(docs(spark, rows).repartition(5), weights, block_tokens=16, shards=4)
    got = drawn.collect()
    uses = Counter((r.source, r.block) for r in got)
    assert all(n <= {"big": 2, "small": 5, "tiny_one": 3}[s] for (s, _), n in uses.items())
    assert all(len({r["repeat"] for r in got if (r.source, r.block) == b}) == n for b, n in uses.items())
    assert len({(r.source, r.slot) for r in got}) == len(got)
    assert all(r.n_tokens == len(r.tokens) == sum(d.n for d in r.docs) <= 16 for r in got)
    shares = {r.source: r for r in mixing.reached_shares(drawn, weights).collect()}
    assert shares["lost"].tokens == shares["nothing"].tokens == 0
    for s, p in (("big", 0.5), ("small", 0.3), ("tiny_one", 0.2)):
        assert shares[s].scaled_share == pytest.approx(p) and shares[s].reached_share == pytest.approx(p, abs=1e-3) and abs(shares[s].deviation) < 1e-3
    assert max(shares[s].most_repeats / m for s, m in (("big", 2), ("small", 5), ("tiny_one", 3))) == 1
    tokenizer = mixing.load_tokenizer(mixing.VOCABULARY, mixing.published_pattern())
    texts = {r[0]: r[1] for r in rows}
    r = got[0]
    assert list(r.tokens) == [t for d in r.docs for t in tokenizer.encode_ordinary(texts[d.doc_id])[d.start : d.start + d.n]]


@needs_vocabulary
def test_sources_smaller_than_a_block_get_their_share(spark):
    rows = [(k, "alpha beta gamma " * 40, None, "big") for k in range(300)] + [(900, "one two three", None, "small"), (901, "four", None, "least")]
    weights = spark.createDataFrame([("big", 0.98, 1), ("small", 0.0004, 2), ("least", 0.0001, 9)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixing.reached_shares(mixing.mixture(docs(spark, rows), weights), weights).collect()}
    assert all(shares[s].tokens > 0 and abs(shares[s].deviation) < 1e-4 for s in ("big", "small", "least"))


@needs_vocabulary
def test_blocks_hold_every_token_once(spark):
    rows = [(k, "word " * (k % 37), None, "ab"[k % 2]) for k in range(200)] + [(999, "long text " * 20_000, None, "a")]
    weights = spark.createDataFrame([("a",), ("b",)], "source string")
    got = mixing.token_blocks(docs(spark, rows).repartition(6), weights, block_tokens=64).collect()
    tokenizer = mixing.load_tokenizer(mixing.VOCABULARY, mixing.published_pattern())
    held = {}
    for r in got:
        at = 0
        for d in r.docs:
            held.setdefault(d.doc_id, {}).update(dict(enumerate(r.tokens[at : at + d.n], d.start)))
            at += d.n
    for k, text, _, _ in rows:
        assert [held.get(k, {})[i] for i in range(len(held.get(k, {})))] == tokenizer.encode_ordinary(text)
    assert sum(r.n_tokens < 64 for r in got) <= 2 and len({(r.source, r.part, r.seq) for r in got}) == len(got)


@needs_vocabulary
def test_mixture_of_empty_tables(spark):
    weights = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(docs(spark, [(1, "x", None, "a")]).limit(0), weights).count() == 0
    assert mixing.mixture(docs(spark, [(1, "x", None, "a")]), weights.limit(0)).count() == 0
    assert [r.tokens for r in mixing.reached_shares(mixing.mixture(docs(spark, [(1, "x", None, "b")]), weights), weights).collect()] == [0]

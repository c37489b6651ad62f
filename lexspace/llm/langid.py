"""Language of every line and document, by character language models.

One interpolated Kneser-Ney model of characters for each language, over folded words with their
boundaries; probabilities lie in arrays sorted by n-gram hash, one row of all languages for each n-gram.
The models are fitted on a bounded sample of labelled documents (`sample_per_language` documents of
each language, chosen by a hash of their id) and refitted on their own labels, so that wrong labels and
foreign lines in the sample lose their weight. Nothing else is sampled: every line of every document is
classified, in one map stage without a shuffle.

A word costs each language its cross-entropy in excess of the best language's, at most `word_cap` nats,
so a line gets the language that most of its words speak for and a foreign quotation can't outvote
them; the lowest cost per character wins. Confidence is a softmax of the costs, with a temperature that
fits held-out lines; a line whose cross-entropy for each character exceeds the `reject_quantile` of held-out
lines by `reject_margin` is marked as rejected: it is in none of the languages.

A line counts if at least `min_words` of its white-space separated words contain a letter. Null or empty
texts have no line; a null id is left out; repeated rows give repeated results, which p10_found makes one;
without any labelled document in the sample there is no model and no result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspace.llm.folding import fold
from lexspace.storage import ship_package

LANGUAGES = ("de", "en", "es", "fr", "he", "it", "nl", "pt")
#: The notations of a language besides its two-letter code: ISO 639-2 (T and B), the English name, older codes.
NOTATIONS = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "castilian"),
    "fr": ("fra", "fre", "french"),
    "he": ("heb", "hebrew", "iw"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "pt": ("por", "portuguese"),
}
SAMPLE_PER_LANGUAGE = 250
ORDER = 5
WORD_CAP = 4.0
MIN_WORDS = 5
SWITCH = 2.0
ALPHABET = 3000.0
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.3
CACHED_WORDS = 1_000_000
_START, _END = 2, 3
_MARKUP = re.compile(r"<[^<>]*>|&[A-Za-z#0-9]+;")
_NOT_LETTERS = re.compile(r"[^\w']|[\d_]")


def two_letter_code(label: Column) -> Column:
    """The code of the language that a label names in any notation; null if it names none of them."""
    base = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)(?:[-_].*)?$", 1)
    known = {n: code for code, names in NOTATIONS.items() for n in (code, *names)}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(pairs, base)


def letters(word: str) -> str:
    """A word as the models see it: folded, without markup, digits and punctuation."""
    if "<" in word or "&" in word:
        word = _MARKUP.sub("", word)
    return _NOT_LETTERS.sub("", fold(word).replace("’", "'")).strip("'")


def main_script(counts: Counter) -> dict[str, float]:
    """The words in the script (by the Unicode name of their first letter) that most words have: quotations in another script fit no model."""
    script = {w: unicodedata.name(w[0], "?").split(" ")[0].split("-")[0] for w in counts}
    sizes: Counter = Counter()
    for w, n in counts.items():
        sizes[script[w]] += n
    return {w: n for w, n in counts.items() if script[w] == max(sizes, key=sizes.get)}


def _grams(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each predicted character: its word, and the hashes of its n-gram and context for each n."""
    text = "".join(chr(_START) * (order - 1) + w + chr(_END) for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + order for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    keep = np.ones(len(codes), bool)
    for i in range(order - 1):
        keep[ends - lengths + i] = False
    at = np.flatnonzero(keep)
    owner = np.repeat(np.arange(len(words)), lengths - order + 1)
    base, grams, contexts = np.uint64(0x9E3779B97F4A7C15), [], []
    rest = np.zeros(len(at), np.uint64)
    power = np.ones(1, np.uint64)
    for n in range(order):
        contexts.append(_mix(rest + np.uint64(n)))
        power = power * base
        grams.append(_mix(codes[at] * np.uint64(0xD1342543DE82EF95) + rest + np.uint64(64 + n)))
        if n + 1 < order:
            rest = rest + codes[at - n - 1] * power
    return owner, grams, contexts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class KneserNey:
    """Interpolated Kneser-Ney models of all languages in sorted hash arrays."""

    def __init__(self, counts: list[dict[str, float]], order: int = ORDER):
        self.order, self.n = order, len(counts)
        parts: list[list[tuple]] = [[] for _ in range(order)]
        for own in counts:
            words = list(own)
            owner, grams, contexts = _grams(words, order)
            weight = np.array([own[w] for w in words], float)[owner]
            for n in range(order):
                if n + 1 < order:  # continuation counts: distinct longer n-grams that end so
                    _, first = np.unique(grams[n + 1], return_index=True)
                    g, c, w = grams[n][first], contexts[n][first], np.ones(len(first))
                else:
                    g, c, w = grams[n], contexts[n], weight
                keys, first, inverse = np.unique(g, return_index=True, return_inverse=True)
                total = np.bincount(inverse, w, len(keys)) if len(keys) else np.zeros(0)
                ones, twos = (total <= 1).sum(), ((total > 1) & (total <= 2)).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                of = c[first]
                ckeys, cinverse = np.unique(of, return_inverse=True)
                ctotal, kinds = np.bincount(cinverse, total, len(ckeys)), np.bincount(cinverse, minlength=len(ckeys))
                parts[n].append((keys, np.maximum(total - discount, 0) / ctotal[cinverse] if len(keys) else total, ckeys, discount * kinds / ctotal if len(ckeys) else ctotal))
        self.grams, self.p, self.contexts, self.back = [], [], [], []
        for each in parts:
            keys, ckeys = np.unique(np.concatenate([x[0] for x in each])), np.unique(np.concatenate([x[2] for x in each]))
            p, back = np.zeros((len(keys), self.n), np.float32), np.ones((len(ckeys), self.n), np.float32)
            for k, x in enumerate(each):
                p[np.searchsorted(keys, x[0]), k] = x[1]
                back[np.searchsorted(ckeys, x[2]), k] = x[3]
            self.grams.append(keys)
            self.p.append(p)
            self.contexts.append(ckeys)
            self.back.append(back)

    def cost(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats of each word in each language, and its predicted characters."""
        out = np.zeros((len(words), self.n), np.float32)
        owner, grams, contexts = _grams(words, self.order)
        for lo in range(0, len(owner), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            p = np.full((len(owner[part]), self.n), 1 / ALPHABET, np.float32)
            for n in range(self.order):
                at, hit = _find(self.contexts[n], contexts[n][part])
                rows = np.flatnonzero(hit)
                p[rows] *= self.back[n][at[rows]]
                at, hit = _find(self.grams[n], grams[n][part])
                rows = np.flatnonzero(hit)
                p[rows] += self.p[n][at[rows]]
            own = owner[part]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[starts]] -= np.add.reduceat(np.log(p), starts, axis=0)
        return out, np.bincount(owner, minlength=len(words)).astype(np.float32)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return at, keys[at] == x if len(keys) else np.zeros(len(x), bool)


class _Words(dict):
    """Word -> number; new words get the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class LanguageModel:
    """Classifies lines; `temperature` and `limit` come from held-out lines."""

    def __init__(self, languages: tuple[str, ...], models: KneserNey, word_cap: float, min_words: int):
        self.languages, self.models, self.word_cap, self.min_words = languages, models, word_cap, min_words
        self.temperature, self.limit = 1.0, np.inf
        self._reset()

    def _reset(self) -> None:
        self._ids, self._known = _Words(), 0
        self._excess, self._least = np.zeros((0, len(self.languages)), np.float32), np.zeros((0, 3), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _learn(self) -> None:
        new = list(self._ids)[self._known :]
        if not new:
            return
        cost, size = self.models.cost(clean := [letters(w) for w in new])
        best = cost.min(axis=1)
        empty = np.array([not w for w in clean])
        excess = np.minimum(cost - best[:, None], self.word_cap)
        excess[empty] = 0
        best[empty] = size[empty] = 0
        alpha = np.fromiter((any(map(str.isalpha, w)) for w in new), np.float32, len(new))
        self._excess = np.concatenate([self._excess, excess])
        self._least = np.concatenate([self._least, np.stack([best, size, alpha], axis=1)])
        self._known = len(self._ids)

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the countable lines: text, line number, excess cost by language, (nats, characters) of the best."""
        if len(self._ids) > CACHED_WORDS:
            self._reset()
        number, flat, where, at = self._ids.__getitem__, [], [], []
        for k, text in enumerate(texts):
            for i, line in enumerate(text.split("\n")):
                words = line.split()
                if len(words) >= self.min_words:
                    where.append((k, i))
                    at.append(len(flat))
                    flat.extend(map(number, words))
        if not where:
            return np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(self.languages))), np.zeros((0, 3))
        self._learn()
        ids, place = np.array(flat), np.array(where)
        excess, least = np.add.reduceat(self._excess[ids], at, axis=0), np.add.reduceat(self._least[ids], at, axis=0)
        counts = least[:, 2] >= self.min_words
        return place[counts, 0], place[counts, 1], excess[counts], least[counts]

    def classify(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Text, line, language number, confidence, nats for each character, rejected; of each countable line."""
        text, line, excess, least = self.lines(texts)
        if not len(text):
            return text, line, text, np.zeros(0), np.zeros(0), np.zeros(0, bool)
        chars = np.maximum(least[:, 1], 1)
        best = excess.argmin(axis=1)
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        sizes = np.diff(np.r_[starts, len(text)])
        main = np.repeat(np.add.reduceat(np.eye(len(self.languages))[best], starts, axis=0).argmax(axis=1), sizes)
        rows = np.arange(len(text))
        best = np.where(excess[rows, main] - excess[rows, best] < SWITCH, main, best)  # a line that can't be told goes with its document
        p = np.exp(-(excess - excess.min(axis=1, keepdims=True)) / self.temperature)
        nats = (least[:, 0] + excess[rows, best]) / chars
        return text, line, best, p[rows, best] / p.sum(axis=1), nats, nats > self.limit


def fit(rows: list[tuple[str | None, str | None]], languages: tuple[str, ...] = LANGUAGES, word_cap: float = WORD_CAP, min_words: int = MIN_WORDS, rounds: int = 3) -> LanguageModel | None:
    """Models from (two-letter code, text): fitted on the labels, then `rounds` - 1 times on the models' own labels of lines."""
    rows = [(c, t) for c, t in rows if c in languages and t]
    if not rows:
        return None
    train, held = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10], [r for i, r in enumerate(rows) if i % 5 == 0]
    counts = [Counter() for _ in languages]
    for code, text in train:
        counts[languages.index(code)].update(text.split())
    model = None
    for k in range(rounds):
        if k:
            texts = [t for _, t in train]
            text, line, best, confidence, _, _ = model.classify(texts)
            split = [t.split("\n") for t in texts]
            counts = [Counter() for _ in languages]
            for t, i, b, c in zip(text.tolist(), line.tolist(), best.tolist(), confidence.tolist(), strict=True):
                if c > 0.9:
                    counts[b].update(split[t][i].split())
        clean = []
        for own in counts:
            c: Counter = Counter()
            for w, n in own.items():
                if x := letters(w):
                    c[x] += n
            clean.append(main_script(c))
        model = LanguageModel(languages, KneserNey(clean), word_cap, min_words)
    _, _, excess, least = model.lines([t for _, t in held])
    text, _, _, _, nats, _ = model.classify([t for _, t in held])
    if len(text):
        model.limit = float(np.quantile(nats, REJECT_QUANTILE) * REJECT_MARGIN)
        label = np.array([languages.index(c) for c, _ in held])[text]
        rows = np.flatnonzero(excess[np.arange(len(label)), label] - excess.min(axis=1) < 2 * word_cap)  # beyond, the label is wrong or the line foreign
        loss = {}
        for temperature in (0.5, 1.0, 2.0, 4.0):
            p = np.exp(-(excess[rows] - excess[rows].min(axis=1, keepdims=True)) / temperature)
            loss[temperature] = -np.log(np.maximum(p[np.arange(len(rows)), label[rows]] / p.sum(axis=1), 1e-9)).sum()
        model.temperature = min(loss, key=loss.get)
    return model


def sample_of(documents: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> list[tuple[str, str]]:
    """At most about 1.3 times `per_language` labelled documents of each language, chosen by a hash of their id."""
    labelled = documents.select(F.xxhash64(F.col(doc_id)).alias("h"), two_letter_code(F.col(lang)).alias("c"), F.col(text).alias("t")).where("c is not null and t is not null")
    sizes = {r.c: r.n for r in labelled.groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    bound = None
    for code, n in sorted(sizes.items()):
        share = (F.col("c") == code) & (F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.3 * per_language / n)) + 1)
        bound = share if bound is None else bound | share
    return [(r.c, r.t) for r in labelled.where(bound).orderBy("h").select("c", "t").collect()]


def language_lines(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    only_wrong: bool = False,
) -> DataFrame:
    """Every countable line: doc_id, line_no, lang, confidence, nats (for each character), rejected, and of its document named (the label's code or null), mixed.

    only_wrong: just the lines of documents that are mixed or whose label doesn't name their language.
    """
    spark = documents.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(fit(sample_of(documents, doc_id, text, lang, sample_per_language)))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), two_letter_code(F.col(lang)).alias("named")).where("doc_id is not null and text != ''")
    schema = "doc_id long, line_no int, lang string, confidence double, nats double, rejected boolean, named string, mixed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches if m else ():
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                owner, line, best, confidence, nats, rejected = m.classify(part.column(1).to_pylist())
                codes = {c: i for i, c in enumerate(m.languages)}
                named = np.array([codes.get(x, -1) for x in part.column(2).to_pylist()])
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
                sizes = np.diff(np.r_[starts, len(owner)])
                mixed = np.repeat(np.maximum.reduceat(best, starts) != np.minimum.reduceat(best, starts), sizes) if len(owner) else np.zeros(0, bool)
                keep = np.flatnonzero(mixed | (named[owner] != best)) if only_wrong else np.arange(len(owner))
                ids, names = part.column(0).to_numpy(zero_copy_only=False), np.array([*m.languages, None], object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[keep]], pa.int64()), pa.array(line[keep], pa.int32()), pa.array(names[best[keep]], pa.string()), pa.array(confidence[keep], pa.float64()), pa.array(nats[keep], pa.float64()), pa.array(rejected[keep]), pa.array(names[named[owner[keep]]], pa.string()), pa.array(mixed[keep])],
                    names=["doc_id", "line_no", "lang", "confidence", "nats", "rejected", "named", "mixed"],
                )

    return docs.mapInArrow(run, schema)

"""Encoders, fetchers, the model registry and the command line, with injected libraries and clients."""

import json
import math
import sys
import zipfile
from types import ModuleType, SimpleNamespace

import numpy as np
import pytest
from fixtures import groups

from lexspace.operators.shuffle import numpy_order
from lexspace.plans import catalog, encode, fetchers, models, pipeline, registry
from lexspace.queries import _Bare, _Hosted, _Tokenizer
from lexspace.sources.corpus import segments
from lexspace.storage import exists, intermediates, materialise

TEXTS = "number int, half_verses array<string>, half_verses_unvocalized array<string>, half_verses_niqqud_only array<string>, half_verse_nodes array<int>"


class Client:
    """Both kinds of client, answering with `vectors(texts)`; remembers its calls."""

    calls: list = []

    def __init__(self, vectors):
        self.vectors = vectors

    def __call__(self, **given):
        Client.calls.append(given)
        self.embeddings = self
        return self

    def create(self, **given):
        Client.calls.append(given)
        return SimpleNamespace(data=[SimpleNamespace(embedding=v) for v in self.vectors(given["input"])])

    def embed(self, **given):
        Client.calls.append(given)
        return SimpleNamespace(embeddings=SimpleNamespace(float_=self.vectors(given["texts"])))


@pytest.mark.parametrize(("slug", "dim", "batch"), [("gemini", 3072, 100), ("openai", 3072, 100), ("cohere", 1536, 96), ("voyage", 1024, 100)])
def test_fetching_in_batches(slug, dim, batch):
    Client.calls = []
    texts = [str(i) for i in range(2 * batch + 7)]
    got = fetchers.fetch(slug, texts, "key", Client(lambda part: [[float(t)] * dim for t in part]))
    assert got.shape == (len(texts), dim) and got.dtype == np.float64 and got[:, 0].tolist() == [float(t) for t in texts]
    made, *asked = Client.calls
    assert made == ({"api_key": "key"} if slug == "cohere" else {"api_key": "key", "base_url": fetchers.ROUTER})
    assert [len(a.get("input") or a["texts"]) for a in asked] == [batch, batch, 7] and {a["model"] for a in asked} == {fetchers.PROVIDERS[slug].model}
    assert all(a["input_type"] == fetchers.INPUT_TYPE if slug == "cohere" else a["encoding_format"] == "float" for a in asked)


@pytest.mark.parametrize("slug", list(fetchers.PROVIDERS))
@pytest.mark.parametrize(("vectors", "message"), [(lambda t: [], "no embeddings"), (lambda t: [[1.0, 2.0]] * len(t), "2 instead of"), (lambda t: [[0.0] * 1536], "1 embeddings for 3|instead of")])
def test_bad_answers(slug, vectors, message):
    with pytest.raises(RuntimeError, match=message):
        fetchers.fetch(slug, ["a", "b", "c"], "key", Client(vectors))


def test_no_texts_and_unknown_providers():
    assert fetchers.fetch("voyage", [], "key", Client(None)).shape == (0, 1024)
    with pytest.raises(KeyError):
        fetchers.fetcher("bge-m3")


def test_clients_are_imported_late(monkeypatch):
    monkeypatch.setitem(sys.modules, "openai", SimpleNamespace(OpenAI="one"))
    monkeypatch.setitem(sys.modules, "cohere", SimpleNamespace(ClientV2="two"))
    assert [fetchers.client_class(s) for s in fetchers.PROVIDERS] == ["one", "one", "two", "one"]


def test_loading():
    assert models.loading("kalm-embedding").device == "cpu" and models.loading("kalm-embedding", mps=True).device == "mps"
    assert models.loading("harrier-oss-v1", cuda=True, mps=True).device == "cuda" and models.loading("harrier-oss-v1", "cuda:1").device == "cuda:1"
    assert models.loading("gte-multilingual-base", cuda=True).device == "cpu" and models.loading("bge-m3", cuda=True).device is None
    assert [s for s in models.CHECKPOINTS if not models.loading(s).own_code] == ["harrier-oss-v1", "f2llm-v2"]
    assert models.loading("f2llm-v2").dtype == "bfloat16" and models.loading("f2llm-v2", dtype="float16").dtype == "float16"
    with pytest.raises(KeyError):
        models.local_encoder("gemini")


def test_sentence_models_get_their_options():
    seen = []

    class Library:
        def __init__(self, *a, **k):
            seen.append((a, k))

        def encode(self, texts, normalize_embeddings):
            return [[1.0, float(normalize_embeddings)] for _ in texts]

    one = models.local_encoder("bge-multilingual-gemma2", factory=Library)()
    assert one(["a"]).tolist() == [[1.0, 1.0]] and seen[0] == (("BAAI/bge-multilingual-gemma2",), {"trust_remote_code": True, "device": None, "model_kwargs": {"torch_dtype": "float16"}})
    one.close()
    assert one.model is None
    models.local_encoder("f2llm-v2", device="cpu", factory=Library)()
    assert seen[1][1]["trust_remote_code"] is False and seen[1][1]["device"] == "cpu"


class Table:
    def __init__(self, values):
        self.values = np.asarray(values)
        self.shape = self.values.shape

    def numpy(self):
        return self.values

    def copy_(self, other):
        self.values = np.asarray(other)


def part(**held):
    return SimpleNamespace(**held)


def tree(*parts):
    return SimpleNamespace(modules=lambda: parts)


def test_rotary_tables_are_repaired():
    one = part(freqs_cos=Table(np.zeros((3, 2))), freqs_sin=Table(np.zeros((3, 2))), config=SimpleNamespace(hidden_size=8, num_attention_heads=2, max_length=3))
    assert models.repair_rotary(tree(part(), one)) == 1
    assert one.freqs_cos.values[2] == pytest.approx([math.cos(2), math.cos(0.02)]) and one.freqs_sin.values[1] == pytest.approx([math.sin(1), math.sin(0.01)])


def test_position_tables_are_repaired():
    right, wrong = part(position_ids=Table([0, 1, 2])), part(position_ids=Table([9, 9, 7]))
    assert models.repair_positions(tree(part(position_ids=None), right, wrong)) == 1 and wrong.position_ids.values.tolist() == [0, 1, 2]


def test_own_code_is_forgotten_before_a_further_attempt(monkeypatch):
    name = models.OWN_CODE_MODULES["gte-multilingual-base"] + ".modeling"
    made = []

    class Library:
        def __init__(self, *a, **k):
            made.append(name in sys.modules)
            monkeypatch.setitem(sys.modules, name, ModuleType(name))

        def __getitem__(self, i):
            return SimpleNamespace(auto_model=tree())

    make = models.local_encoder("gte-multilingual-base", factory=Library)
    make()
    sys.modules[name] = ModuleType(name)
    make()
    assert made == [False, False]
    held = {"a.b": 1, "a.c": 2, "d": 3}
    assert models.evict_modules("a.", held) == ["a.b", "a.c"] and held == {"d": 3}


def fake_torch(cuda, mps=False):
    freed = []
    properties = lambda i: SimpleNamespace(total_memory=16e9)
    return SimpleNamespace(
        cuda=SimpleNamespace(is_available=lambda: cuda, memory_allocated=lambda: 1.5e9, memory_reserved=lambda: 2e9, get_device_properties=properties, empty_cache=lambda: freed.append("cuda")),
        backends=SimpleNamespace(mps=SimpleNamespace(is_available=lambda: mps)), mps=SimpleNamespace(empty_cache=lambda: freed.append("mps")), freed=freed,
    )


def test_memory():
    assert models.memory_summary(fake_torch(True)) == "allocated=1.50GB reserved=2.00GB total=16.00GB" and models.memory_summary(fake_torch(False)) is None
    both = fake_torch(True, True)
    models.free_memory(both)
    assert both.freed == ["cuda", "mps"]


def test_pooling_follows_the_padding():
    hidden = np.arange(24, dtype=float).reshape(2, 3, 4)
    right = models.pool_last(hidden, [[1, 1, 0], [1, 1, 1]])
    left = models.pool_last(hidden, [[0, 1, 1], [1, 1, 1]])
    assert right[0] == pytest.approx(hidden[0, 1] / np.linalg.norm(hidden[0, 1])) and left[0] == pytest.approx(hidden[0, 2] / np.linalg.norm(hidden[0, 2]))
    assert (right[1] == left[1]).all() and right.dtype == np.float32


def test_plain_models(spark):
    make = models.local_encoder("harrier-oss-v1", "cpu", load_tokenizer=lambda c, **o: _Tokenizer(), load_model=lambda c, **o: _Bare())
    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, None)], "node_id int, text string").coalesce(1)
    got = {r.node_id: list(r.vector) for r in encode.encode(rows, make, dim=2).collect()}
    for node, c in ((1, 98), (2, 99), (3, 0)):
        assert got[node] == pytest.approx([c / math.hypot(c, 1000), 1000 / math.hypot(c, 1000)])


def test_choices(spark):
    assert [m.slug for m in registry.models_for_choice("harrier")] == ["harrier-oss-v1"] and len(registry.models_for_choice(None)) == 6
    with pytest.raises(KeyError):
        registry.models_for_choice("bge-m3")


def test_acquiring(tmp_path):
    cloned = []

    def clone(address, to):
        cloned.append(address)
        (tmp_path / "data" / "corpus").mkdir()

    assert models.acquired(str(tmp_path), "x", clone, "there") == str(tmp_path)
    for _ in range(2):
        assert models.acquired(str(tmp_path / "no"), str(tmp_path / "data"), clone, "there", "sub") == str(tmp_path / "data" / "corpus" / "sub")
    assert cloned == ["there"]


def test_numpy_order_of_many_groups(spark):
    own = segments(groups(spark, *[[["A"]] * n for n in (1, 4, 11)]))
    for seed in (1, 30):
        got = {(r.group_id, r.position): r.seg_idx for r in numpy_order(own, seed).collect()}
        for g, n in ((1, 1), (2, 4), (3, 11)):
            assert [got[g, i] for i in range(n)] == np.random.default_rng((g, seed)).permutation(n).tolist()


@pytest.fixture()
def tables(spark, tmp_path):
    texts = spark.createDataFrame([(1, ["abcd", None], ["ab", "a"], ["abc", "b"], [100, 101])], TEXTS)
    texts.write.parquet(str(tmp_path / "texts"))
    groups(spark, [["A", "B"], ["B"]], [["A"]]).write.parquet(str(tmp_path / "groups"))
    words = "node int, half_verse_node int, number int, lex string, lex0 string, freq_lex int, g_cons string, g_word string, trailer string, loaded_at timestamp"
    import datetime

    at = datetime.datetime(2025, 1, 1)
    spark.createDataFrame([(i, 1, 1, v, v, 3, v, v, "", at) for i, v in enumerate("AB")], words).write.parquet(str(tmp_path / "words"))
    return tmp_path


def command(tables, what, groups_, *options, **given):
    return pipeline.main([what, "--groups", str(tables / groups_), "--words", str(tables / "words"), "--output-root", str(tables / "out"), *options], **given)


def test_command_line(spark, tables, capsys):
    some = ["--constructions", "binary", "icf_spacing2"]
    assert command(tables, "lexical", "groups", *some) == ["homograph_binary", "homograph_icf_spacing2", "lexeme_binary", "lexeme_icf_spacing2"]
    assert "lexeme_icf_spacing2\n4 datasets written" in capsys.readouterr().err
    assert command(tables, "lexical", "groups", *some) == []
    assert len(command(tables, "shuffle", "groups", "--n-shuffles", "3")) == 3 and len(command(tables, "shuffle-segments", "groups", "--n-shuffles", "1", "--order", "hash")) == 1
    assert len(catalog.leaves(str(tables / "out"), spark)) == 8
    with pytest.raises(RuntimeError, match="lacks the features"):
        command(tables, "surface", "groups", *some)
    with pytest.raises(SystemExit):
        pipeline.main(["lexical", "--groups", "x", "--output-root", "y"])
    with pytest.raises(FileNotFoundError):
        command(tables, "lexical", "none")


def test_a_missing_weight_is_an_error_unless_lenient(spark, tables):
    groups(spark, [["A", "new"]]).write.mode("overwrite").parquet(str(tables / "groups"))
    with pytest.raises(Exception, match="no weight for the value new"):
        command(tables, "lexical", "groups", "--constructions", "icf")
    assert len(command(tables, "lexical", "groups", "--constructions", "icf", "--lenient")) == 2


def test_semantic_command_line(spark, tables, capsys):
    encoders = {m.slug: lambda m=m: lambda texts: [[float(len(t)), 1.0, *[0.0] * (m.dim - 2)] for t in texts] for m in registry.MODELS if m.path != "api"}
    given = {"encoders": encoders, "fetchers": {s: fetchers.fetcher(s, _Hosted) for s in fetchers.PROVIDERS}, "env": dict.fromkeys(encode.KEY_VARIABLES.values(), "key")}
    assert command(tables, "semantic", "texts", "--models", "cohere", "miqrabert", **given) == ["semantic_miqrabert_consonantal", *[f"semantic_cohere_embed_v4_{v.name}" for v in registry.VARIATIONS]]
    assert "semantic_cohere_embed_v4_vocalized\n" in capsys.readouterr().err
    assert command(tables, "semantic", "texts", "--models", "miqrabert", "bge-m3", "--variation", "vocalized", **given) == ["semantic_bge_m3_vocalized"]
    assert command(tables, "large", "texts", "--choice", "kalm", "--variation", "consonantal", encoders=encoders) == ["semantic_kalm_embedding_gemma3_12b_2511_consonantal"]
    with pytest.raises(RuntimeError, match="OPENROUTER_API_KEY"):
        command(tables, "semantic", "texts", "--models", "openai", fetchers=given["fetchers"], env={})


def test_every_model_is_in_the_whole_run(monkeypatch):
    monkeypatch.setattr(pipeline, "generate_api", lambda nested, root, slug, *a, **k: [slug])
    monkeypatch.setattr(pipeline, "generate_local", lambda nested, root, slug, *a, **k: [slug])
    assert pipeline.generate_all(None, "") == [m.slug for m in registry.MODELS]
    assert pipeline.generate_large(None, "", None) == [m.slug for m in registry.MODELS if m.path == "large"]
    with pytest.raises(KeyError):
        pipeline.generate_all(None, "", slugs=("none",))


def test_listing_and_archive(spark, tmp_path):
    root = str(tmp_path / "out")
    row = spark.createDataFrame([(1, [1.0])], "node_id int, vector array<float>")
    catalog.write_dataset(row, catalog.lexical_path(root, "lexeme", "icf"), "one")
    before = catalog.listing(spark, root)
    catalog.write_dataset(row, catalog.semantic_path(root, "bge_m3", "vocalized"), "two")
    new = catalog.new_leaves(before, catalog.listing(spark, root))
    assert [r.leaf for r in new.collect()] == ["type=semantic/model=bge_m3/text=vocalized"]
    names = catalog.archive(spark, root, new, str(tmp_path / "new.zip"))
    with zipfile.ZipFile(tmp_path / "new.zip") as z:
        assert sorted(z.namelist()) == sorted(names) and all(n.startswith("type=semantic/model=bge_m3/text=vocalized/") for n in names)
        assert json.loads(z.read(next(n for n in names if n.endswith(catalog.SIDECAR))))["description"] == "two"


def test_larger_datasets_get_several_files(spark, tmp_path):
    assert catalog.files_of(0, 4) == 1 and catalog.files_of(1 << 20, 64) == 1 and catalog.files_of(1 << 20, 6400) == 100
    leaf = f"{tmp_path}/type=a/b=c/d=e"
    catalog.write_dataset(spark.range(100).selectExpr("cast(id as int) as node_id", "array(cast(id as float)) as vector"), leaf, "", files=3)
    assert len(list((tmp_path / "type=a/b=c/d=e").glob("*.parquet"))) == 3 and spark.read.parquet(leaf).count() == 100


def test_intermediates_are_deleted(spark):
    with intermediates(spark):
        kept = materialise(spark.range(3), "some")
        path = kept.inputFiles()[0].rpartition("/")[0]
        assert kept.count() == 3 and exists(spark, path)
    assert not exists(spark, path)

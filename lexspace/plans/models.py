"""Embedding models that run in the tasks: how each checkpoint is loaded, encoded and freed.

Everything heavy is imported when it is first needed and can be injected, so the module needs none of it. An encoder is made once per
task (see encode.encode) and made anew for each further attempt; tensors are pooled as numpy arrays, whatever device they come from.
"""

from __future__ import annotations

import gc
import importlib
import os
import sys
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass
from typing import Any

import numpy as np

from lexspace.plans.registry import BY_SLUG

MAX_TOKENS = 512

#: The checkpoint of each model that isn't hosted.
CHECKPOINTS = {
    "miqrabert": "davidmsmiley/MiqraBERT",
    "alephbert": "imvladikon/sentence-transformers-alephbert",
    "neodictabert": "dicta-il/neodictabert-bilingual-embed",
    "berel": "dicta-il/BEREL",
    "bge-multilingual-gemma2": "BAAI/bge-multilingual-gemma2",
    "qwen3-embedding": "Qwen/Qwen3-Embedding-8B",
    "kalm-embedding": "tencent/KaLM-Embedding-Gemma3-12B-2511",
    "llama-embed-nemotron": "nvidia/llama-embed-nemotron-8b",
    "harrier-oss-v1": "microsoft/harrier-oss-v1-27b",
    "f2llm-v2": "codefuse-ai/F2LLM-v2-14B",
    "bge-m3": "BAAI/bge-m3",
    "gte-multilingual-base": "Alibaba-NLP/gte-multilingual-base",
    "me5-large-instruct": "intfloat/multilingual-e5-large-instruct",
}
#: Models that the sentence library can't load, that need no code of their own, that start on the CPU, and the part of the
#: module names under which the last kind's own code is cached.
PLAIN_TRANSFORMERS = ("kalm-embedding", "harrier-oss-v1")
NO_OWN_CODE = ("harrier-oss-v1", "f2llm-v2")
CPU_FIRST = ("gte-multilingual-base",)
OWN_CODE_MODULES = {"gte-multilingual-base": "transformers_modules.Alibaba_hyphen_NLP"}


@dataclass(frozen=True)
class Loading:
    """What a checkpoint is loaded with; a device of None leaves the choice to the library."""

    checkpoint: str
    plain: bool
    own_code: bool
    device: str | None
    dtype: str | None
    attempts: int


def loading(slug: str, device: str | None = None, dtype: str | None = None, cuda: bool = False, mps: bool = False) -> Loading:
    """The loading of a model; a device asked for comes first, a model loaded by itself takes the best that is there. An unknown model is a KeyError."""
    plain = slug in PLAIN_TRANSFORMERS
    if device is None and plain:
        device = "cuda" if cuda else "mps" if mps else "cpu"
    elif device is None and slug in CPU_FIRST:
        device = "cpu"
    return Loading(CHECKPOINTS[slug], plain, slug not in NO_OWN_CODE, device, dtype or BY_SLUG[slug].dtype, BY_SLUG[slug].attempts)


def _numpy(x: Any) -> np.ndarray:
    """An array of a tensor of any device and precision, or of what numpy takes itself."""
    for step in ("detach", "float", "cpu", "numpy"):
        if hasattr(x, step):
            x = getattr(x, step)()
    return np.asarray(x)


def pool_last(hidden: Any, mask: Any) -> np.ndarray:
    """Last hidden states under a mask, at length one. If all rows' masks end with 1 (padding on the left) that is the last place, else the place of the last 1."""
    h, m = _numpy(hidden), _numpy(mask).astype(np.int64)
    at = np.full(len(m), m.shape[1] - 1) if m[:, -1].all() else m.sum(axis=1) - 1
    out = h[np.arange(len(h)), at].astype(np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _parts(model: Any) -> Iterator[Any]:
    return iter(model.modules())


def repair_rotary(model: Any, theta: float = 10000.0) -> int:
    """Fill the rotary tables that loading leaves empty; the number of repaired parts."""
    n = 0
    for part in _parts(model):
        if getattr(part, "freqs_cos", None) is None:
            continue
        dim = part.config.hidden_size // part.config.num_attention_heads
        angle = np.outer(np.arange(part.config.max_length, dtype=np.float32), theta ** (-2.0 * np.arange(dim // 2, dtype=np.float32) / dim))
        part.freqs_cos.copy_(_like(part.freqs_cos, np.cos(angle)))
        part.freqs_sin.copy_(_like(part.freqs_sin, np.sin(angle)))
        n += 1
    return n


def repair_positions(model: Any) -> int:
    """Put 0, 1, 2, ... back into position tables that were loaded with anything else; the number of repaired parts."""
    n = 0
    for part in _parts(model):
        held = getattr(part, "position_ids", None)
        if not hasattr(held, "copy_"):
            continue
        right = np.arange(held.shape[0])
        if not np.array_equal(_numpy(held), right):
            held.copy_(_like(held, right))
            n += 1
    return n


def _like(held: Any, values: np.ndarray) -> Any:
    """The values as the tensors that `held` is one of."""
    return held.new_tensor(values) if hasattr(held, "new_tensor") else values


def evict_modules(fragment: str, modules: MutableMapping[str, Any] | None = None) -> list[str]:
    """Forget the imported modules whose name has a fragment, so that they are imported anew."""
    modules = sys.modules if modules is None else modules
    stale = sorted(m for m in modules if fragment in m)
    for m in stale:
        del modules[m]
    return stale


def free_memory(torch: Any = None) -> None:
    """Give back what a dropped model held, on the devices there are."""
    gc.collect()
    torch = torch or _torch()
    if torch is None:
        return
    if torch.cuda.is_available():
        torch.cuda.empty_cache()
    if torch.backends.mps.is_available():
        torch.mps.empty_cache()


def memory_summary(torch: Any = None) -> str | None:
    """Memory of the first GPU in GB, or None without one."""
    torch = torch or _torch()
    if torch is None or not torch.cuda.is_available():
        return None
    sizes = {"allocated": torch.cuda.memory_allocated(), "reserved": torch.cuda.memory_reserved(), "total": torch.cuda.get_device_properties(0).total_memory}
    return " ".join(f"{k}={v / 1e9:.2f}GB" for k, v in sizes.items())


def _torch() -> Any:
    try:
        return importlib.import_module("torch")
    except ImportError:
        return None


class SentenceEncoder:
    """Texts to vectors of length one by the sentence library's model."""

    def __init__(self, slug: str, how: Loading, factory: Callable[..., Any] | None, again: bool):
        if again and slug in OWN_CODE_MODULES:
            evict_modules(OWN_CODE_MODULES[slug])
        factory = factory or importlib.import_module("sentence_transformers").SentenceTransformer
        extra = {"model_kwargs": {"torch_dtype": how.dtype}} if how.dtype else {}
        self.model = factory(how.checkpoint, trust_remote_code=how.own_code, device=how.device, **extra)
        if slug == "neodictabert":
            repair_rotary(self.model[0].auto_model)
        if slug in OWN_CODE_MODULES:
            repair_positions(self.model[0].auto_model)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return _numpy(self.model.encode(texts, normalize_embeddings=True))

    def close(self) -> None:
        self.model = None
        free_memory()


class PlainEncoder:
    """Texts to pooled vectors of length one by a tokenizer and a bare model."""

    def __init__(self, how: Loading, load_tokenizer: Callable[..., Any] | None, load_model: Callable[..., Any] | None):
        if load_tokenizer is None or load_model is None:
            transformers = importlib.import_module("transformers")
            load_tokenizer, load_model = load_tokenizer or transformers.AutoTokenizer.from_pretrained, load_model or transformers.AutoModel.from_pretrained
        extra = {"torch_dtype": how.dtype} if how.dtype else {}
        self.tokenizer = load_tokenizer(how.checkpoint, trust_remote_code=how.own_code)
        self.model = load_model(how.checkpoint, trust_remote_code=how.own_code, **extra).to(how.device)
        self.model.eval()
        self.device = how.device

    def __call__(self, texts: list[str]) -> np.ndarray:
        given = {k: v.to(self.device) if hasattr(v, "to") else v for k, v in self.tokenizer(texts, padding=True, truncation=True, max_length=MAX_TOKENS, return_tensors="pt").items()}
        torch = _torch()
        if torch is None:
            answer = self.model(**given)
        else:
            with torch.no_grad():
                answer = self.model(**given)
        return pool_last(answer.last_hidden_state, given["attention_mask"])

    def close(self) -> None:
        self.tokenizer = self.model = None
        free_memory()


def local_encoder(slug: str, device: str | None = None, dtype: str | None = None, factory: Callable[..., Any] | None = None, load_tokenizer: Callable[..., Any] | None = None, load_model: Callable[..., Any] | None = None) -> Callable[[], Callable]:
    """A maker of encoders of a model for encode.encode; each call loads the checkpoint. factory, load_tokenizer and load_model replace the libraries."""
    CHECKPOINTS[slug]
    made = []

    def make() -> Callable:
        torch = _torch() if slug in PLAIN_TRANSFORMERS and device is None else None
        how = loading(slug, device, dtype, cuda=bool(torch and torch.cuda.is_available()), mps=bool(torch and torch.backends.mps.is_available()))
        again = bool(made)
        made.append(1)
        return PlainEncoder(how, load_tokenizer, load_model) if how.plain else SentenceEncoder(slug, how, factory, again)

    return make


def acquired(default: str, folder: str, clone: Callable[[str, str], None], address: str, inner: str = "") -> str:
    """The folder of the corpus: `default` if it is there, else `inner` of a copy below `folder`, which is cloned from `address` if it isn't there either."""
    if os.path.exists(default):
        return default
    os.makedirs(folder, exist_ok=True)
    copy = os.path.join(folder, "corpus")
    if not os.path.exists(copy):
        clone(address, copy)
    return os.path.join(copy, inner) if inner else copy

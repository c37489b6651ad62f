"""Embeddings from hosted models: one batched, checked fetch over the providers' two kinds of client.

Vectors come back in the order of the texts, in double precision and as the provider gives them (not normalised). A batch without
vectors, with another number of vectors than texts, or with a vector of another dimension than the model's is a RuntimeError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np

from lexspace.plans.registry import BY_SLUG

#: The router's address, and what the second provider calls texts that are to be searched.
ROUTER = "https://openrouter.ai/api/v1"
INPUT_TYPE = "search_document"


@dataclass(frozen=True)
class Provider:
    model: str
    routed: bool


#: The models' names at their providers.
PROVIDERS = {
    "gemini": Provider("google/gemini-embedding-2", routed=True),
    "openai": Provider("openai/text-embedding-3-large", routed=True),
    "cohere": Provider("embed-v4.0", routed=False),
    "voyage": Provider("voyageai/voyage-4", routed=True),
}


def client_class(slug: str) -> Callable[..., Any]:
    """The provider's client, imported when it is first needed."""
    if PROVIDERS[slug].routed:
        import openai

        return openai.OpenAI
    import cohere

    return cohere.ClientV2


def _ask(client: Any, provider: Provider, texts: list[str]) -> list:
    if provider.routed:
        answer = client.embeddings.create(model=provider.model, input=texts, encoding_format="float")
        return [x.embedding for x in answer.data or []]
    answer = client.embed(model=provider.model, input_type=INPUT_TYPE, texts=texts, embedding_types=["float"])
    return list(answer.embeddings.float_ or [])


def batches(texts: list[str], size: int) -> Iterable[list[str]]:
    return (texts[lo : lo + size] for lo in range(0, len(texts), size))


def fetch(slug: str, texts: list[str], key: str, client_factory: Callable[..., Any] | None = None) -> np.ndarray:
    """(texts, dimension) vectors of a provider; no texts, no request."""
    provider, model = PROVIDERS[slug], BY_SLUG[slug]
    make = client_factory or client_class(slug)
    client = make(api_key=key, base_url=ROUTER) if provider.routed else make(api_key=key)
    out = [np.zeros((0, model.dim))]
    for part in batches(texts, model.batch or len(texts)):
        got = _ask(client, provider, part)
        if not got:
            raise RuntimeError(f"{provider.model} returned no embeddings for {len(part)} texts")
        if len(got) != len(part):
            raise RuntimeError(f"{provider.model} returned {len(got)} embeddings for {len(part)} texts")
        if wrong := next((len(v) for v in got if len(v) != model.dim), None):
            raise RuntimeError(f"{provider.model} returned a vector of {wrong} instead of {model.dim} dimensions")
        out.append(np.asarray(got, np.float64))
    return np.concatenate(out)


def fetcher(slug: str, client_factory: Callable[..., Any] | None = None) -> Callable[[list[str], str], np.ndarray]:
    """fetch(texts, key) of one provider; an unknown one is a KeyError."""
    PROVIDERS[slug]
    return lambda texts, key: fetch(slug, texts, key, client_factory)

"""Embedding models, text variations, and the datasets they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variation:
    name: str
    vocalized: bool
    niqqud_only: bool
    description: str


@dataclass(frozen=True)
class Model:
    slug: str
    dataset: str
    dim: int
    path: str  # local, large or api
    strips_marks: bool = False
    dtype: str | None = None
    batch: int | None = None
    attempts: int = 1


#: The text variations.
VARIATIONS = (
    Variation("consonantal", False, False, "consonants only"),
    Variation("vocalized", True, True, "with vowel points"),
    Variation("cantillation", True, False, "with vowel points and accents"),
)

#: Models by slug, their dataset names and dimensions.
MODELS = (
    Model("miqrabert", "miqrabert", 768, "local", strips_marks=True),
    Model("alephbert", "alephbert", 768, "local", strips_marks=True),
    Model("neodictabert", "neodictabert", 768, "local", strips_marks=True),
    Model("berel", "berel", 768, "local", strips_marks=True),
    Model("bge-multilingual-gemma2", "bge_multilingual_gemma2", 3584, "large", dtype="float16"),
    Model("qwen3-embedding", "qwen3_embedding_8b", 4096, "large", dtype="auto"),
    Model("kalm-embedding", "kalm_embedding_gemma3_12b_2511", 3840, "large", dtype="bfloat16"),
    Model("llama-embed-nemotron", "llama_embed_nemotron_8b", 4096, "large", dtype="bfloat16"),
    Model("harrier-oss-v1", "harrier_oss_v1_27b", 5376, "large", dtype="auto"),
    Model("f2llm-v2", "f2llm_v2_14b", 5120, "large", dtype="bfloat16"),
    Model("bge-m3", "bge_m3", 1024, "local"),
    Model("gte-multilingual-base", "gte_multilingual_base", 768, "local", attempts=5),
    Model("me5-large-instruct", "me5_large_instruct", 1024, "local"),
    Model("gemini", "gemini_embedding_2", 3072, "api", batch=100),
    Model("openai", "openai_text_embedding_3_large", 3072, "api", batch=100),
    Model("cohere", "cohere_embed_v4", 1536, "api", batch=96),
    Model("voyage", "voyage_4", 1024, "api", batch=100),
)
BY_SLUG = {m.slug: m for m in MODELS}


def variations_for_model(slug: str) -> tuple[Variation, ...]:
    """Models that drop diacritics get only the consonants; an unknown slug is a KeyError."""
    return VARIATIONS[:1] if BY_SLUG[slug].strips_marks else VARIATIONS


#: The short names of the large models.
ALIASES = {
    "bge": "bge-multilingual-gemma2",
    "qwen3": "qwen3-embedding",
    "kalm": "kalm-embedding",
    "llama-nemotron": "llama-embed-nemotron",
    "harrier": "harrier-oss-v1",
    "f2llm": "f2llm-v2",
}


def models_for_choice(choice: str | None) -> tuple[Model, ...]:
    """The large model of that short name or slug, or all of them; an unknown choice is a KeyError."""
    large = {m.slug: m for m in MODELS if m.path == "large"}
    return tuple(large.values()) if choice is None else (large[ALIASES.get(choice, choice)],)


def large_models(spark: SparkSession) -> DataFrame:
    """(choice, model, dtype): the models of each choice; the choice of all is null."""
    rows = [(choice, m.slug, m.dtype) for choice in (None, *ALIASES) for m in models_for_choice(choice)]
    return spark.createDataFrame(rows, "choice string, model string, dtype string")


def dataset_name(slug: str, variation: str) -> str:
    return f"semantic_{BY_SLUG[slug].dataset}_{variation}"


def dataset_description(slug: str, variation: Variation) -> str:
    m = BY_SLUG[slug]
    return f"{m.dataset} embeddings of each segment, {variation.description}; node_id int32, vector float32[{m.dim}]"


def model_variations(spark: SparkSession) -> DataFrame:
    """(model, variation, dataset, dim, leaf, description): every dataset of the registry, as a filtered product of two literal tables."""
    models = spark.createDataFrame([(m.slug, m.dataset, m.dim, m.strips_marks) for m in MODELS], "model string, d string, dim int, strips boolean")
    variations = spark.createDataFrame([(v.name, v.description) for v in VARIATIONS], "variation string, about string")
    plan = models.crossJoin(F.broadcast(variations)).where("not strips or variation = 'consonantal'")  # literal tables
    leaf = F.concat(F.lit("type=semantic/model="), F.col("d"), F.lit("/text="), F.col("variation"))
    text = F.format_string("%s embeddings of each segment, %s; node_id int32, vector float32[%d]", "d", "about", "dim")
    return plan.select("model", "variation", F.concat_ws("_", F.lit("semantic"), "d", "variation").alias("dataset"), "dim", leaf.alias("leaf"), text.alias("description"))

"""Pipelines: all datasets of a corpus, each written once."""

from __future__ import annotations

import argparse
import math
import os
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspace.functions.dense import densify
from lexspace.operators.frequency import frequency, icf_weights, surface_counts, surface_words, total_tokens
from lexspace.operators.shuffle import numpy_order, shuffled_order
from lexspace.plans.catalog import files_of, is_written, lexical_path, semantic_path, write_dataset, write_entries
from lexspace.plans.constructions import CONSTRUCTIONS, GROUP_CONSTRUCTIONS, Prepared, build, prepare
from lexspace.plans.encode import Encoder, api_key, encode, model_batch
from lexspace.plans.fetchers import PROVIDERS, fetcher
from lexspace.plans.models import local_encoder
from lexspace.plans.registry import ALIASES, BY_SLUG, MODELS, dataset_description, dataset_name, models_for_choice, variations_for_model
from lexspace.sources.corpus import LEXICAL_COLUMNS, LEXICAL_UNITS, SURFACE_COLUMNS, TEXT_COLUMNS, TIERS, WORD_COLUMNS, load_corpus, one_delivery, variant
from lexspace.storage import release


def _place(unit: str) -> tuple[str, str | None, str]:
    """(unit folder, text folder, name prefix) of a unit."""
    return (unit, None, unit) if unit in LEXICAL_UNITS else ("word", unit, f"word_{unit}")


def lexical_plan(spark: SparkSession) -> DataFrame:
    """(unit, construction, dataset, leaf) of every dataset of words: units times constructions."""
    rows = []
    for u in (*LEXICAL_UNITS, *TIERS):
        folder, text, prefix = _place(u)
        rows.append((prefix, lexical_path("", folder, "", text).lstrip("/")))
    units = spark.createDataFrame(rows, "unit string, folder string")
    names = spark.createDataFrame([(c,) for c in CONSTRUCTIONS], "construction string")
    return units.crossJoin(F.broadcast(names)).select("unit", "construction", F.concat_ws("_", "unit", "construction").alias("dataset"), F.concat("folder", "construction").alias("leaf"))  # literal tables


#: Entries that a task encodes, twice the counted terms being the most that a construction has.
PART_ENTRIES = 1 << 18


@dataclass(frozen=True)
class _Shape:
    """What all datasets of a unit share: the vocabulary's size, the tasks that write, and the node ids between their parts."""

    size: int
    parts: int
    bounds: list[float]


def _kept(p: Prepared) -> Prepared:
    """The relations, cached. The dictionary comes first: what is cached after it is made of it, not of its tables once again."""
    entries = p.dictionary.persist()
    return Prepared(p.segments.persist(), p.tf.persist(), entries)


def _shape(p: Prepared) -> _Shape:
    size = p.dictionary.agg(F.max("size").alias("v")).first().v or 0
    parts = max(1, math.ceil(2 * p.tf.count() / PART_ENTRIES))
    bounds = p.segments.approxQuantile("node_id", [k / parts for k in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    return _Shape(int(size), parts, sorted(bounds))


def _write(prepared: Prepared, shape: _Shape, name: str, leaf: str, label: str, order: DataFrame | None = None) -> None:
    dim = CONSTRUCTIONS[name][1](shape.size)
    about = f"{label}: {name} vectors of each segment, dimension {dim}"
    if not dim:
        write_dataset(densify(build(name, prepared, order), prepared.segments, dim), leaf, about)
        return
    features = GROUP_CONSTRUCTIONS[name](prepared, order) if name in GROUP_CONSTRUCTIONS else build(name, prepared, order)
    write_entries(features, prepared.segments, dim, leaf, about, shape.bounds, shape.parts)
    del features
    release(prepared.segments.sparkSession)


def generate(nested: DataFrame, weights: Mapping[str, DataFrame], root: str, units: tuple[str, ...] = LEXICAL_UNITS, constructions: tuple[str, ...] = tuple(CONSTRUCTIONS), unseen: DataFrame | None = None) -> list[str]:
    """Write the dataset of every unit and construction that isn't written yet; returns the names of those written. unseen: see `prepare`. A unit's relations are cached while its datasets are made."""
    done = []
    for unit in units:
        folder, text, prefix = _place(unit)
        missing = [c for c in constructions if not is_written(lexical_path(root, folder, c, text), nested.sparkSession)]
        if not missing:
            continue
        p = prepare(nested, unit, weights=weights[unit], unseen=unseen)
        p = _kept(p)
        shape = _shape(p)
        for c in missing:
            print(f"{prefix}_{c}", file=sys.stderr)
            _write(p, shape, c, lexical_path(root, folder, c, text), prefix)
            done.append(f"{prefix}_{c}")
        for df in (p.segments, p.tf, p.dictionary):
            df.unpersist()
    return done


def generate_surface(nested: DataFrame, weights: Mapping[str, DataFrame], root: str, **options) -> list[str]:
    return generate(nested, weights, root, units=TIERS, **options)


def generate_shuffled(nested: DataFrame, weights: DataFrame, root: str, n_shuffles: int = 30, construction: str = "icf_position_mean_psalm", label: str = "icf_position_mean_psalm_shuffle", order: Callable[[DataFrame, int], DataFrame] = numpy_order, unseen: DataFrame | None = None) -> list[str]:
    """Datasets of a construction with the segments of each group permuted, seeds 1..n; written again at each run. order: the permutation of a seed."""
    p = prepare(nested, "homograph", weights=weights, unseen=unseen)
    p = _kept(p)
    shape, names = _shape(p), []
    for seed in range(1, n_shuffles + 1):
        name = f"{label}{seed:02d}"
        print(f"homograph_{name}", file=sys.stderr)
        _write(p, shape, construction, lexical_path(root, "homograph", name), name, order(p.segments, seed))
        names.append(f"homograph_{name}")
    for df in (p.segments, p.tf, p.dictionary):
        df.unpersist()
    return names


def generate_shuffled_segments(nested: DataFrame, weights: DataFrame, root: str, n_shuffles: int = 30, **options) -> list[str]:
    return generate_shuffled(nested, weights, root, n_shuffles, "icf_position4", "icf_position4_shuffle", **options)


def text_segments(nested: DataFrame, vocalized: bool, niqqud_only: bool) -> DataFrame:
    """(group_id, seg_idx, node_id, text) of a text table in one variation."""
    own = one_delivery(nested.select("number", "half_verse_nodes", variant(vocalized, niqqud_only).alias("t"), *[c for c in ("loaded_at",) if c in nested.columns]), "number")
    return own.select(F.col("number").alias("group_id"), F.posexplode(F.arrays_zip("half_verse_nodes", "t")).alias("seg_idx", "z")).select("group_id", "seg_idx", F.col("z.half_verse_nodes").alias("node_id"), F.col("z.t").alias("text")).where("node_id is not null")


def _semantic(nested: DataFrame, root: str, slug: str, factory: Callable[[], Callable[[], Encoder]], variation: str | None, check_dim: bool, normalise: bool) -> list[str]:
    done, model, made = [], BY_SLUG[slug], None
    for v in variations_for_model(slug):
        leaf = semantic_path(root, model.dataset, v.name)
        if variation not in (None, v.name) or is_written(leaf, nested.sparkSession):
            continue
        made = made or factory()
        print(dataset_name(slug, v.name), file=sys.stderr)
        rows = text_segments(nested, v.vocalized, v.niqqud_only)
        vectors = encode(rows, made, model.dim if check_dim else None, model_batch(slug), model.attempts, normalise)
        write_dataset(vectors, leaf, dataset_description(slug, v), files_of(rows.count(), model.dim))
        done.append(dataset_name(slug, v.name))
    return done


def generate_local(nested: DataFrame, root: str, slug: str, make_encoder: Callable[[], Encoder], variation: str | None = None, check_dim: bool = True) -> list[str]:
    """Embeddings of a model that runs in the tasks, at length one; variations already written or not asked for are skipped."""
    return _semantic(nested, root, slug, lambda: make_encoder, variation, check_dim, normalise=True)


def generate_api(nested: DataFrame, root: str, slug: str, fetch: Callable[[list[str], str], list[list[float]]] | None = None, env: Mapping[str, str] | None = None, check_dim: bool = True, variation: str | None = None) -> list[str]:
    """Embeddings fetched from an API, as they come; the key is read only if something is missing, on the driver. The provider's own client and the process's environment are the defaults."""
    fetch = fetch or fetcher(slug)

    def factory() -> Callable[[], Encoder]:
        key = api_key(slug, dict(os.environ if env is None else env))
        return lambda: lambda texts: fetch(texts, key)

    return _semantic(nested, root, slug, factory, variation, check_dim, normalise=False)


def generate_all(
    nested: DataFrame,
    root: str,
    encoders: Mapping[str, Callable[[], Encoder]] | None = None,
    fetchers: Mapping[str, Callable] | None = None,
    env: Mapping[str, str] | None = None,
    slugs: tuple[str, ...] = tuple(BY_SLUG),
    variation: str | None = None,
    device: str | None = None,
) -> list[str]:
    """Every missing dataset of the models `slugs` (all of the registry), in the registry's order; models without an encoder or fetcher given use the libraries'. An unknown model is a KeyError."""
    done = []
    for slug in slugs:
        BY_SLUG[slug]
    for m in MODELS:
        if m.slug not in slugs:
            continue
        if m.slug in PROVIDERS:
            done += generate_api(nested, root, m.slug, (fetchers or {}).get(m.slug), env, variation=variation)
        else:
            done += generate_local(nested, root, m.slug, (encoders or {}).get(m.slug) or local_encoder(m.slug, device), variation)
    return done


def generate_large(nested: DataFrame, root: str, choice: str | None = None, encoders: Mapping[str, Callable[[], Encoder]] | None = None, **options) -> list[str]:
    """The large models of a choice (see models_for_choice), one after the other."""
    return generate_all(nested, root, encoders, slugs=tuple(m.slug for m in models_for_choice(choice)), **options)


def corpus_weights(corpus: DataFrame, unit: str, total: DataFrame | None = None, once: DataFrame | None = None) -> DataFrame:
    """total, once: of the corpus, if they are there already (`total_tokens`, `surface_words`)."""
    counted = surface_counts(once, unit) if once is not None and unit in TIERS else frequency(corpus, unit)
    return icf_weights(counted, total_tokens(corpus) if total is None else total)


def main(argv: list[str] | None = None, encoders: Mapping[str, Callable[[], Encoder]] | None = None, fetchers: Mapping[str, Callable] | None = None, env: Mapping[str, str] | None = None) -> list[str]:
    """python -m lexspace.plans.pipeline {lexical,surface,shuffle,shuffle-segments,semantic,large} --groups PATH [--words PATH] --output-root PATH

    Returns the names of the datasets written. encoders, fetchers and env replace the libraries, the providers and the process's environment.
    """
    parser = argparse.ArgumentParser(prog="lexspace", description="Write the datasets of a corpus that aren't written yet.")
    parser.add_argument("what", choices=["lexical", "surface", "shuffle", "shuffle-segments", "semantic", "large"])
    parser.add_argument("--groups", required=True, help="the nested table: lexical, surface or text groups")
    parser.add_argument("--words", help="the flat table of words that the weights are counted over")
    parser.add_argument("--output-root", required=True)
    parser.add_argument("--n-shuffles", type=int, default=30)
    parser.add_argument("--order", choices=["numpy", "hash"], default="numpy", help="the permutation of a seed")
    parser.add_argument("--constructions", nargs="+", choices=list(CONSTRUCTIONS), default=list(CONSTRUCTIONS), metavar="NAME")
    parser.add_argument("--lenient", action="store_true", help="a value without a frequency weighs like frequency 0 instead of being an error")
    parser.add_argument("--models", nargs="+", choices=list(BY_SLUG), default=list(BY_SLUG), metavar="MODEL")
    parser.add_argument("--choice", choices=list(ALIASES), help="one large model")
    parser.add_argument("--variation")
    parser.add_argument("--device")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lexspace").getOrCreate()

    def corpus(path: str, columns: tuple[str, ...]) -> DataFrame:
        """The features asked for, and when they were delivered if that is told."""
        every = load_corpus(spark, path)
        return load_corpus(spark, path, (*columns, *[c for c in ("loaded_at",) if c in every.columns]))

    if a.what in ("semantic", "large"):
        texts = corpus(a.groups, TEXT_COLUMNS)
        if a.what == "large":
            done = generate_large(texts, a.output_root, a.choice, encoders, env=env, variation=a.variation, device=a.device)
        else:
            done = generate_all(texts, a.output_root, encoders, fetchers, env, tuple(a.models), a.variation, a.device)
    else:
        if not a.words:
            parser.error(f"{a.what} needs --words")
        nested, flat = corpus(a.groups, SURFACE_COLUMNS if a.what == "surface" else LEXICAL_COLUMNS), corpus(a.words, WORD_COLUMNS)
        total, once = total_tokens(flat).persist(), surface_words(flat).persist() if a.what == "surface" and "loaded_at" in flat.columns else None
        unseen = total if a.lenient else None
        if a.what in ("lexical", "surface"):
            units = LEXICAL_UNITS if a.what == "lexical" else TIERS
            done = generate(nested, {u: corpus_weights(flat, u, total, once) for u in units}, a.output_root, units, tuple(a.constructions), unseen)
        else:
            make = generate_shuffled if a.what == "shuffle" else generate_shuffled_segments
            done = make(nested, corpus_weights(flat, "homograph", total), a.output_root, a.n_shuffles, order=numpy_order if a.order == "numpy" else shuffled_order, unseen=unseen)
        for df in (total, once):
            if df is not None:
                df.unpersist()
    print(f"{len(done)} datasets written", file=sys.stderr)
    return done


if __name__ == "__main__":
    main()

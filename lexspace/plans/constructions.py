"""The vector constructions by name, over any unit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lexspace.operators import frequency, position, recurrence, vectors
from lexspace.operators.vocabulary import dictionary, vocabulary
from lexspace.sources.corpus import segments, tokens


@dataclass(frozen=True)
class Prepared:
    """A unit's relations that all constructions share."""

    segments: DataFrame
    tf: DataFrame
    dictionary: DataFrame


def prepare(nested: DataFrame, unit: str, corpus: DataFrame | None = None, strict: bool = True, weights: DataFrame | None = None, unseen: DataFrame | None = None) -> Prepared:
    """Relations of a unit of nested groups; weights are given or counted over `corpus`, without either every value weighs 1. strict: a value without a weight is an error, unless `unseen` (total) is given."""
    words = tokens(nested, unit)
    if weights is None and corpus is not None:
        total = frequency.total_tokens(corpus)
        weights = frequency.icf_weights(frequency.frequency(corpus, unit), total)
        unseen = None if strict else total
    entries = dictionary(vocabulary(words), weights, unseen)
    return Prepared(segments(nested), vectors.term_frequency(words, entries), entries)


#: The constructions of whole groups before they go to each segment: name -> builder of (group_id, idx, val).
GROUP_CONSTRUCTIONS: dict[str, Callable] = {
    **{f"icf_position{k}_psalm": lambda p, order=None, k=k: position.group_pyramid(p.tf, k, order) for k in (2, 4, 8)},
    **{f"icf_spacing{k}_psalm": lambda p, order=None, k=k: recurrence.group_spacing(p.tf, p.segments, k, order) for k in (2, 4, 8)},
    "icf_position_mean_psalm": lambda p, order=None: position.group_zoning(p.tf, order),
}


def _of_group(name: str) -> Callable:
    """A group's vector for each of its segments."""
    return lambda p, order=None: position.to_segments(GROUP_CONSTRUCTIONS[name](p, order), p.segments)


def _pyramid(k: int) -> Callable:
    return lambda p, order=None: position.pyramid(p.tf, k, order).select("node_id", "idx", "val")


def _spacing(k: int) -> Callable:
    return lambda p, order=None: recurrence.spacing(p.tf, p.segments, k, order)


#: name -> (long-form builder over Prepared and an optional order, dimension of a vocabulary of V). The names are fixed values: they are dataset names.
CONSTRUCTIONS: dict[str, tuple[Callable, Callable[[int], int]]] = {
    "binary": (lambda p, order=None: vectors.binary(p.tf), lambda v: v),
    "count": (lambda p, order=None: vectors.count(p.tf), lambda v: v),
    "log_count": (lambda p, order=None: vectors.log_count(p.tf), lambda v: v),
    "icf": (lambda p, order=None: vectors.icf(p.tf), lambda v: v),
    "tf_icf": (lambda p, order=None: vectors.tf_icf(p.tf), lambda v: v),
    **{f"icf_position{k}": (_pyramid(k), lambda v, k=k: k * v) for k in (2, 4, 8)},
    **{f"icf_spacing{k}": (_spacing(k), lambda v, k=k: k) for k in (2, 4, 8)},
    "icf_position_mean": (lambda p, order=None: position.zoning(p.tf, order), lambda v: 2 * v),
    **{f"icf_position{k}_psalm": (_of_group(f"icf_position{k}_psalm"), lambda v, k=k: k * v) for k in (2, 4, 8)},
    **{f"icf_spacing{k}_psalm": (_of_group(f"icf_spacing{k}_psalm"), lambda v, k=k: k) for k in (2, 4, 8)},
    "icf_position_mean_psalm": (_of_group("icf_position_mean_psalm"), lambda v: 2 * v),
}


def build(name: str, prepared: Prepared, order: DataFrame | None = None) -> DataFrame:
    """(node_id, idx, val) of a construction, entries that aren't 0 or a mean; an unknown name is a ValueError."""
    if name not in CONSTRUCTIONS:
        raise ValueError(f"unknown construction {name!r}")
    return CONSTRUCTIONS[name][0](prepared, order)

"""Constructions, dataset catalog, model registry, encoders and the pipelines over them."""

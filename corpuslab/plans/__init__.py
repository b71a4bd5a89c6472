"""Whole jobs built from the operators, and the registered queries."""

from importlib import import_module

MODULES = ["text_queries", "term_queries", "category_queries", "model_queries", "latent_queries", "linear_queries", "tree_queries", "file_queries"]


def load_queries() -> None:
    """Import every query module, which enters its queries in the registry."""
    for name in MODULES:
        import_module(f"corpuslab.plans.{name}")

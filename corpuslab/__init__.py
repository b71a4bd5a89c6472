"""Document-collection analytics on Spark DataFrames."""

from corpuslab.session import build_session

__all__ = ["build_session"]

"""Masked mixture clustering on Spark DataFrames."""

from maskmix.config import MixtureConfig

__all__ = ["MixtureConfig"]

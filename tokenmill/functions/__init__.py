"""Column-level helpers: fixed constants, deterministic draws, array expressions."""

from tokenmill.functions import constants
from tokenmill.functions.hashing import hash32, uniform, uniform_sql

__all__ = ["constants", "hash32", "uniform", "uniform_sql"]

"""Column helpers shared by the operators."""

from .hashing import md5_mod, sha256_mod, stable_fraction
from .ordering import positional_join, row_index, running_before
from .values import dataset_name, falsy_default, py_strip, ratio, signature

__all__ = ["dataset_name", "falsy_default", "md5_mod", "positional_join", "py_strip", "ratio", "row_index", "running_before", "sha256_mod", "signature", "stable_fraction"]

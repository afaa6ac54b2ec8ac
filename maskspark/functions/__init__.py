"""Masking functions: each builds Spark SQL text from the SQL texts of its arguments, so that masks stay in codegen."""

from . import builtins, dummy, fake, generalize, hashing, image, noise, partial, random  # noqa: F401
from .base import FUNCTIONS, Context, MaskFunction, mask_function

__all__ = ["FUNCTIONS", "Context", "MaskFunction", "mask_function"]

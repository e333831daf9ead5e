"""The bank of grid operators; importing it registers them all."""

from tessel.operators import color, geometry, lines, objects, relations  # noqa: F401
from tessel.operators.base import OPERATORS, Operator

__all__ = ["OPERATORS", "Operator"]

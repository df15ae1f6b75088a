"""Connected components of a link table; the engine's own."""

from finsift.operators.components import connected

__all__ = ["connected"]

"""Where the registered queries keep tables."""

from ..sources.scratch import scratch, stored

__all__ = ["scratch", "stored"]

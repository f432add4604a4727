"""Intermediate tables, which the linkage operators use, too."""

from ..sources.storage import Scratch, shared_root

__all__ = ["Scratch", "shared_root"]

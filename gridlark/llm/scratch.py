"""The library's intermediate tables, for the operators of this subpackage."""

from gridlark.scratch import Scratch, shared_dir, short_shuffles

__all__ = ["Scratch", "shared_dir", "short_shuffles"]

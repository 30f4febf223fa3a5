"""Intermediate tables in the folder that driver and executors share."""

from depscope.sources.shared import settled, shared_dir

__all__ = ["settled", "shared_dir"]

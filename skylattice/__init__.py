"""Positional analysis of sky catalogues on Spark DataFrames."""

from skylattice.session import checkpointed, get_session, scratch_folder

__all__ = ["checkpointed", "get_session", "scratch_folder"]

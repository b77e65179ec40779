"""Intermediate tables in the folder that the cluster shares."""

from vialume.plans.store import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

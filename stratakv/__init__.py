"""A versioned key-value engine on Spark DataFrames.

    from stratakv import Builder, open_store, Included, Excluded, UNBOUNDED
"""

from .errors import StoreError
from .operators.store import Builder, KVStore, Options, SyncMode, open_store
from .plans.bounds import UNBOUNDED, Bound, Excluded, Included

__all__ = ["UNBOUNDED", "Bound", "Builder", "Excluded", "Included", "KVStore", "Options", "StoreError", "SyncMode", "open_store"]

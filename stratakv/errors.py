"""Errors of the store. One class each, so callers can catch what they handle."""


class StoreError(Exception):
    """Base of all."""


class GenericError(StoreError):
    """Anything without a class of its own."""


class StorageIOError(StoreError):
    """The file system failed."""


class BadLogState(StoreError):
    """The write log was used in the wrong state, such as after it was deleted."""


class BadLogSeq(StoreError):
    """The write log's sequence has a gap."""


class KeyTooLarge(StoreError):
    pass


class KeyEmpty(StoreError):
    pass


class ValueTooLarge(StoreError):
    pass


class ValueEmpty(StoreError):
    pass


class DuplicateKey(StoreError):
    """A batch without seq has several writes of one key, and nothing says which is the last."""


class DatabaseShutdown(StoreError):
    """Kept for callers that catch it; shutdown() does nothing, so nothing raises it."""


class DataDirMissing(StoreError):
    pass


class NeedFlush(StoreError):
    """Both write buffers are full: call flush_oldest_memtable() and try again."""


class CompactionAlreadyRunning(StoreError):
    pass


class CompactionCommitFailure(StoreError):
    """The runs that were compacted are no longer the oldest ones."""


#: Reject reasons of bulk validation, as raised in strict mode.
BY_REASON = {c.__name__: c for c in (KeyEmpty, KeyTooLarge, ValueEmpty, ValueTooLarge, DuplicateKey)}

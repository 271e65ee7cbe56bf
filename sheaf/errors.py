"""Errors that the library raises."""

from __future__ import annotations


class SheafError(Exception):
    """Base of all errors of this library."""


class RecordNotFoundError(SheafError):
    def __init__(self, record_id, collection: str):
        super().__init__(f"no live record {record_id!r} in collection {collection!r}")
        self.record_id, self.collection = record_id, collection


class DuplicateIndexError(SheafError):
    def __init__(self, field: str, value):
        super().__init__(f"{value!r} is taken: {field!r} must be unique")
        self.field, self.value = field, value


class SchemaValidationError(SheafError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = list(errors)


class TransactionError(SheafError):
    pass


class EncryptionError(SheafError):
    pass


class CorruptionError(SheafError):
    def __init__(self, path: str, detail: str = ""):
        super().__init__(f"{path} is damaged" + (f": {detail}" if detail else ""))
        self.path, self.detail = path, detail


class LockTimeoutError(SheafError):
    def __init__(self, path: str, timeout: float):
        super().__init__(f"other writers kept {path} busy for {timeout:g} s")
        self.path, self.timeout = path, timeout

"""Spark-native document collections."""

from sheaf.errors import (
    CorruptionError,
    DuplicateIndexError,
    EncryptionError,
    LockTimeoutError,
    RecordNotFoundError,
    SchemaValidationError,
    SheafError,
    TransactionError,
)
from sheaf.operators.schema import Field, Schema
from sheaf.plans.query import Query, from_df
from sheaf.sources.store import Collection, Database, Store, Transaction

__version__ = "0.1.0"

__all__ = [
    "Collection", "CorruptionError", "Database", "DuplicateIndexError", "EncryptionError", "Field", "LockTimeoutError", "Query",
    "RecordNotFoundError", "Schema", "SchemaValidationError", "SheafError", "Store", "Transaction", "TransactionError", "from_df",
]

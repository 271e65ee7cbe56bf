"""Encryption of documents: PBKDF2 on the driver, AES-256-GCM in Spark.

Cipher texts are ``nonce | cipher text | tag`` in base64. Documents are always
encrypted from a column, never from a literal, which the optimizer would fold
into one value with one nonce. Ids, times and the deletion mark stay plain, as
versions are resolved by them. The key is part of query plans: treat event
logs and the UI of such sessions as secret.
"""

from __future__ import annotations

import base64
import hashlib
import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sheaf.errors import EncryptionError

ITERATIONS, KEY_BYTES, SALT_BYTES = 260_000, 32, 16
_CHECK = "sheaf-key-check"


class Cipher:
    def __init__(self, spark: SparkSession, password: str, salt: bytes | None = None):
        if not isinstance(password, str) or not password:
            raise EncryptionError("a password is needed")
        self.spark, self.salt = spark, salt or os.urandom(SALT_BYTES)
        self._key = hashlib.pbkdf2_hmac("sha256", password.encode(), self.salt, ITERATIONS, KEY_BYTES)

    def encrypt_column(self, text: Column) -> Column:
        return F.base64(F.aes_encrypt(text.cast("binary"), F.lit(self._key), F.lit("GCM")))

    def decrypt_column(self, text: Column) -> Column:
        """Null where key or text are wrong."""
        return F.try_aes_decrypt(F.unbase64(text), F.lit(self._key), F.lit("GCM")).cast("string")

    def _each(self, values: list[str], apply) -> list[str | None]:
        if not values:
            return []
        frame = self.spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(1)
        return [r[0] for r in frame.select("i", apply(F.col("v")).alias("o")).orderBy("i").select("o").collect()]

    def encrypt_many(self, texts: list[str]) -> list[str]:
        return self._each(texts, self.encrypt_column)

    def decrypt_many(self, texts: list[str]) -> list[str]:
        for t in texts:
            try:
                base64.b64decode(t, validate=True)
            except ValueError as e:
                raise EncryptionError("not a cipher text") from e
        out = self._each(texts, self.decrypt_column)
        if any(t is None for t in out):
            raise EncryptionError("wrong password or damaged data")
        return out

    def encrypt_str(self, text: str) -> str:
        return self.encrypt_many([text])[0]

    def decrypt_str(self, text: str) -> str:
        return self.decrypt_many([text])[0]

    def key_check(self) -> str:
        return self.encrypt_str(_CHECK)

    def verify(self, token: str) -> None:
        if self.decrypt_str(token) != _CHECK:
            raise EncryptionError("wrong password")

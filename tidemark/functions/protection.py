"""Payload protection: AES-GCM with a key that the caller holds, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def protected(payload: Column, key: Column) -> Column:
    """Base64 of the encrypted payload; every call has a nonce of its own, so equal payloads differ."""
    return F.base64(F.aes_encrypt(F.encode(payload, "UTF-8"), key))


def unprotected(text: Column, key: Column) -> Column:
    """The payload; null where the key is another's or the text was changed."""
    return F.decode(F.try_aes_decrypt(F.unbase64(text), key), "UTF-8")

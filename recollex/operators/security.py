"""Encryption of columns and the key behind a password."""

from __future__ import annotations

import hashlib
import hmac
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS, HEADER = 600_000, "ENCv1:"


def derive_key(password: str, salt: bytes) -> bytes:
    """A 256-bit key by PBKDF2 with SHA-256; once, on the driver."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)


def encrypt(c: Column, key: bytes) -> Column:
    """AES-256-GCM with a random nonce for every row, as header and base64."""
    return F.concat(F.lit(HEADER), F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM"))))


def decrypt(c: Column, key: bytes) -> Column:
    """The text; null if the header lacks, the key is wrong or the value was changed."""
    body = F.when(F.startswith(c, F.lit(HEADER)), F.unbase64(F.substring(c, len(HEADER) + 1, 2**31 - 1)))
    return F.try_aes_decrypt(body, F.lit(key), F.lit("GCM")).cast("string")


def password_record(password: str) -> str:
    """What is stored of a password: a random salt and its key."""
    salt = os.urandom(16)
    return f"{salt.hex()}${derive_key(password, salt).hex()}"


def verify_password(password: str, record: str) -> bool:
    """Whether a password is the recorded one, in constant time."""
    salt, _, key = record.partition("$")
    return hmac.compare_digest(derive_key(password, bytes.fromhex(salt)).hex(), key)

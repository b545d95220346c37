"""How chunks are stored: compression, encryption, and the file extension that names the layers."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from millrace.functions.xchacha import seal, unseal

ALGORITHMS = ("xchacha20-poly1305", "aes-256-gcm")


@F.pandas_udf(BinaryType())
def zstd(data: pd.Series) -> pd.Series:
    codec = pa.Codec("zstd")
    return data.map(lambda x: None if x is None else codec.compress(x, asbytes=True))


@F.pandas_udf(BinaryType())
def unzstd(data: pd.Series) -> pd.Series:
    """The bytes of whole zstd frames; null if they aren't valid."""
    import io

    import zstandard

    def one(x):
        if x is None:
            return None
        try:
            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(x), read_across_frames=True).read()
        except zstandard.ZstdError:
            return None

    return data.map(one)


def sealed(key: bytes, back: bool):
    """XChaCha20-Poly1305 as an Arrow function: a random nonce of 24 bytes, the ciphertext, the tag of 16 bytes."""

    def each(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else (unseal if back else seal)(key, bytes(x)))

    return F.pandas_udf(each, BinaryType())


def encrypted(data: Column, key: bytes, algorithm: str = "aes-256-gcm") -> Column:
    """AES-256-GCM: a random nonce of 12 bytes, the ciphertext, the tag of 16 bytes. Or XChaCha20-Poly1305."""
    if algorithm != "aes-256-gcm":
        return sealed(key, back=False)(data)
    return F.aes_encrypt(data, F.unhex(F.lit(key.hex())), F.lit("GCM"))


def decrypted(data: Column, key: bytes, algorithm: str = "aes-256-gcm") -> Column:
    """Null where the key is wrong or the data were changed."""
    if algorithm != "aes-256-gcm":
        return sealed(key, back=True)(data)
    return F.try_aes_decrypt(data, F.unhex(F.lit(key.hex())), F.lit("GCM"))


def key_id(key: bytes) -> str:
    """The first four bytes of the key's SHA-256, in hex."""
    import hashlib

    return hashlib.sha256(key).hexdigest()[:8]


def check_options(encryption: bool, algorithm: str | None, key: str | None) -> None:
    if not encryption:
        if algorithm or key:
            raise ValueError("an algorithm or key needs encryption to be on")
        return
    if algorithm and algorithm not in ALGORITHMS:
        raise ValueError(f"unsupported algorithm {algorithm}")
    if not key or len(key) != 64 or any(c not in "0123456789abcdefABCDEF" for c in key):
        raise ValueError("a key is 64 hexadecimal digits")


def extension(compress: bool = True, algorithm: str | None = None, key: bytes | None = None) -> str:
    out = ".cacnk" if compress else ""
    return out + (f".{algorithm}-{key_id(key)}" if algorithm and key else "")


def to_storage(data: Column, compress: bool = True, key: bytes | None = None, algorithm: str = "aes-256-gcm") -> Column:
    """Plain bytes through the layers in order; `from_storage` takes them back in reverse."""
    out = zstd(data) if compress else data
    return encrypted(out, key, algorithm) if key else out


def from_storage(data: Column, compress: bool = True, key: bytes | None = None, algorithm: str = "aes-256-gcm") -> Column:
    out = decrypted(data, key, algorithm) if key else data
    return unzstd(out) if compress else out

"""SHA-256 that one process lays down and another takes up: hashlib's objects cannot be stored.

The functions are OpenSSL's own, of the library that hashlib itself is linked with. Nothing of ctypes is
kept in the module, as its functions travel to tasks by value.
"""

from __future__ import annotations

import ctypes

import _hashlib

STATE_BYTES = 112  # SHA256_CTX of openssl/sha.h: 28 plain numbers of 32 bits, no pointers


def available() -> bool:
    """Whether this Python's OpenSSL offers the functions."""
    try:
        return hasattr(ctypes.CDLL(_hashlib.__file__), "SHA256_Update")
    except (AttributeError, OSError):
        return False


class Sha256:
    """A running SHA-256; `state` is what another one goes on from."""

    def __init__(self, state: bytes | None = None) -> None:
        self._lib = ctypes.CDLL(_hashlib.__file__)
        self._lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        self._context = ctypes.create_string_buffer(state or bytes(STATE_BYTES), STATE_BYTES)
        if state is None:
            self._lib.SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._context, data, len(data))

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        digest = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(digest, ctypes.create_string_buffer(self._context.raw, STATE_BYTES))
        return digest.raw.hex()

"""Errors of the stores."""


class StoreError(Exception):
    """Any error below."""


class NotFound(StoreError, KeyError):
    """The key has no live record."""


class Closed(StoreError):
    """The store or handle was closed."""


class Corrupt(StoreError):
    """Stored state can't be trusted."""


class EmptyKey(StoreError, ValueError):
    """Keys have at least one byte."""


class KeyTooLarge(StoreError, ValueError):
    """Keys have at most MAX_KEY bytes."""


class NoLineKey(StoreError, ValueError):
    """The key function finds no key in a line, or another one than was meant."""


class InvalidLine(StoreError, ValueError):
    """A line holds no line feed."""


class ManagerClosed(StoreError):
    """The manager was closed."""


MAX_KEY = 65535


def checked_key(key: bytes | str) -> bytes:
    key = key.encode() if isinstance(key, str) else bytes(key)
    if not key:
        raise EmptyKey("empty key")
    if len(key) > MAX_KEY:
        raise KeyTooLarge(f"{len(key)} bytes")
    return key

"""Expressions over keys and values, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display(value: Column) -> Column:
    """Text where the bytes are UTF-8, else their hexadecimal digits."""
    text = value.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.hex(value))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    shorter = F.least(F.length(a), F.length(b))
    at = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, shorter)


def record_crc(key: Column, value: Column) -> Column:
    return F.crc32(F.concat(key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))))


def message_key(channel: Column, msg_id: Column) -> Column:
    """``m_``, the channel and the id as eight big-endian bytes: byte order is the order of ids."""
    return F.concat(F.lit(b"m_"), channel.cast("binary"), F.unhex(F.lpad(F.hex(msg_id), 16, "0")))


def record_bytes(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def readable(n: int) -> str:
    """A byte count with its value in the largest fitting unit of 1024."""
    size = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{n}({size:.3f}{unit})"
        size /= 1024
    return f"{n}({size:.3f}TB)"

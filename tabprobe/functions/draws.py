"""Keyed random draws.

Every draw is a hash of (seed, tag, row key). A row therefore gets the same number however
the table is partitioned, and a task that is retried after a lost executor gets it again.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = 4294967296.0


def _column(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def digest(seed: int | str, tag: str, key: Column | str) -> Column:
    """md5 text of ``seed:tag:key``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), _column(key).cast("string")))


def _unit(hex_text: Column, start: int) -> Column:
    """Eight hex digits as a number strictly between 0 and 1."""
    bits = F.conv(F.substring(hex_text, start, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(_TWO32)


def draw_u(seed: int | str, tag: str, key: Column | str) -> Column:
    """Uniform draw in (0, 1)."""
    return _unit(digest(seed, tag, key), 1)


def draw_n(seed: int | str, tag: str, key: Column | str) -> Column:
    """Standard normal draw (Box-Muller on two halves of one digest)."""
    text = digest(seed, tag, key)
    radius = F.sqrt(F.lit(-2.0) * F.ln(_unit(text, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _unit(text, 9))


def digest_text(seed: int | str, tag: str, key: object) -> str:
    """Plain-Python twin of :func:`digest`, for choices among column names."""
    return hashlib.md5(f"{seed}:{tag}:{key}".encode()).hexdigest()


def u_text(seed: int | str, tag: str, key: object) -> float:
    """Plain-Python twin of :func:`draw_u`."""
    return (int(digest_text(seed, tag, key)[:8], 16) + 0.5) / _TWO32


def shuffled(names: list[str], seed: int | str, tag: str) -> list[str]:
    """Names in keyed random order."""
    return sorted(names, key=lambda name: (digest_text(seed, tag, name), name))


def spec_seed(seed: int, injector: str, params: dict[str, str]) -> int:
    """31-bit seed of one injection, from the run seed and the injector's own parameters."""
    listed = ",".join(f"{k}={params[k]}" for k in sorted(params))
    return int(hashlib.md5(f"{seed}:{injector}:{listed}".encode()).hexdigest()[:8], 16) % 2**31

"""Counter-based random numbers from md5.

``rand()`` depends on partitioning and differs between engines; an md5 of a
seed and a row key gives the same value on every engine, every partition
count and every retry of a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _hex_int(hexstr: Column, start: int, width: int) -> Column:
    return F.conv(F.substring(hexstr, start, width), 16, 10).cast("bigint")


def md5_hex(*parts) -> Column:
    cols = [F.lit(p) if not isinstance(p, Column) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def md5_unit(*parts) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of md5("p1:p2:...")."""
    return _hex_int(md5_hex(*parts), 1, 8) / F.lit(TWO_32)


def md5_key(*parts) -> Column:
    """60-bit ordering key (first 15 hex digits) for seeded shuffles."""
    return _hex_int(md5_hex(*parts), 1, 15)


def md5_normal(*parts) -> Column:
    """Standard normal by Box-Muller on two 32-bit halves of one md5."""
    h = md5_hex(*parts)
    u1 = (_hex_int(h, 1, 8) + F.lit(0.5)) / F.lit(TWO_32)
    u2 = _hex_int(h, 9, 8) / F.lit(TWO_32)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


def hashed_token_id(word: Column, vocab_size: int) -> Column:
    """Id in 1..vocab_size-1 for a token string; 0 stays free for EOS/BOS/UNK."""
    return (F.lit(1) + _hex_int(F.md5(word), 1, 8) % F.lit(vocab_size - 1)).cast("int")

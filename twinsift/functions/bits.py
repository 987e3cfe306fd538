"""64-bit fingerprint expressions. A fingerprint is a BIGINT holding the 64 bits; hex only at the edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.schemas import GRID_HEIGHT, GRID_WIDTH, HASH_BITS

# Fixed value: one to sixteen hex digits, any number of leading zeros, an optional plus sign.
HEX_PATTERN = "^[+]?0*[0-9a-fA-F]{1,16}$"


def signed64(value: int) -> int:
    """The BIGINT that holds the given unsigned 64 bits."""
    value &= (1 << HASH_BITS) - 1
    return value - (1 << HASH_BITS) if value >> (HASH_BITS - 1) else value


def phash_hex(phash: Column | str) -> Column:
    """16 lowercase hex digits, most significant bit first."""
    return F.lower(F.lpad(F.hex(phash), 16, "0"))


def phash_from_hex(text: Column | str) -> Column:
    """Inverse of :func:`phash_hex`; null where the text is not a 64-bit hex number."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.regexp_replace(text, "^[+]", "")
    return F.when(text.rlike(HEX_PATTERN), F.conv(digits, 16, -10).cast("bigint"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two BIGINT fingerprints."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Distance of two hex fingerprints; null if either is not valid."""
    return hamming(phash_from_hex(a), phash_from_hex(b))


def dhash9x8(gray: Column | str) -> Column:
    """Difference hash of a 9x8 gray grid given as array of 72 numbers, row by row.

    One bit per horizontal neighbour pair, set when the left cell is darker. The first pair is the
    most significant bit. The 64 comparisons are unrolled so the expression stays inside codegen.
    """
    gray = F.col(gray) if isinstance(gray, str) else gray
    terms = []
    for row in range(GRID_HEIGHT):
        for col in range(GRID_WIDTH - 1):
            cell = row * GRID_WIDTH + col
            place = HASH_BITS - 1 - (row * (GRID_WIDTH - 1) + col)
            bit = F.lit(signed64(1 << place)).cast("bigint")
            terms.append(F.when(gray[cell] < gray[cell + 1], bit).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda x, y: x.bitwiseOR(y), terms)

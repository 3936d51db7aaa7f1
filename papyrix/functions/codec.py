"""Variable-byte and Elias gamma codes, d-gaps: byte-exact encoders and decoders, and their sizes as expressions."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vbyte_encode(numbers) -> bytes:
    """Seven bits a byte, low bits first; the high bit says that more follow."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("no code for a negative number")
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def gamma_encode(numbers) -> bytes:
    """A one, a zero for each further bit, then the low bits; zeros fill the last byte."""
    bits = ""
    for n in numbers:
        if n < 1:
            raise ValueError("gamma codes start at 1")
        low = f"{n:b}"[1:]
        bits += "1" + "0" * len(low) + low
    bits += "0" * (-len(bits) % 8)
    return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:] if bits else b""


def gamma_decode(data: bytes, count: int) -> list[int]:
    """The first reading of ``count`` codes that leaves less than a byte of zeros; shorter codes are tried first.

    The code alone does not tell where it ends (low bits can go on with zeros), so readings are searched.
    """
    bits = "".join(f"{b:08b}" for b in data)
    tries, out = [(0, 0)], []  # (place, length to try)
    while tries:
        at, z = tries.pop()
        if len(out) > len(tries):
            del out[len(tries) :]
        if len(out) == count and len(bits) - at < 8 and "1" not in bits[at:]:
            return out
        if len(out) < count and at + 2 * z < len(bits) and bits[at] == "1" and "1" not in bits[at + 1 : at + 1 + z]:
            tries.append((at, z + 1))
            out.append(int("1" + bits[at + 1 + z : at + 1 + 2 * z], 2))
            tries.append((at + 1 + 2 * z, 0))
    raise ValueError(f"no {count} codes in these bytes")


def dgaps(ids: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *ids], ids)]


def un_dgaps(gaps: list[int]) -> list[int]:
    return list(accumulate(gaps))


def bit_length(n: Column) -> Column:
    return F.length(F.bin(n))


def vbyte_size(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bit_length(n) / 7)).cast("long")


def gamma_bits(n: Column) -> Column:
    return (2 * bit_length(n) - 1).cast("long")


def vbyte_array(numbers: np.ndarray) -> bytes:
    """``vbyte_encode`` of an array of numbers that are not negative, a byte place at a time."""
    n = numbers.astype(np.uint64)
    sizes = vbyte_sizes(numbers)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(n) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        here = sizes > k
        out[ends[here] - sizes[here] + k] = (n[here] >> np.uint64(7 * k)) & np.uint64(127) | np.where(sizes[here] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def un_vbyte_array(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b[: ends[-1] + 1] & 127) << 7 * place, starts)


def vbyte_sizes(numbers: np.ndarray) -> np.ndarray:
    """How many bytes each number's code has."""
    sizes, most = np.ones(len(numbers), np.int64), int(numbers.max(initial=0))
    for k in range(1, 10):
        if most < 1 << 7 * k:
            break
        sizes += numbers >= 1 << 7 * k
    return sizes


def vbyte_column(n: Column) -> Column:
    """``vbyte_encode`` of one number a row."""
    group = lambda k: F.shiftright(n, 7 * k).bitwiseAND(127) + F.when(n >= 1 << 7 * (k + 1), 128).otherwise(0) if k < 8 else F.shiftright(n, 56)
    byte = lambda k: F.lpad(F.hex(group(k)), 2, "0")
    return F.unhex(F.concat(byte(0), *[F.when(n >= 1 << 7 * k, byte(k)).otherwise("") for k in range(1, 9)]))


def bit_lengths(numbers: np.ndarray) -> np.ndarray:
    """Bits of each number, which must be 1 or more."""
    if len(numbers) and numbers.min() < 1:
        raise ValueError("gamma codes start at 1")
    return np.frexp(numbers.astype(np.float64))[1].astype(np.int64)


def gamma_rows(numbers: np.ndarray, sizes: np.ndarray, readable: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The codes of many lists, each of whole bytes: the bytes, where each list's end in them, and each list's number of bits.

    numbers are all lists' one after another, sizes (not 0) how many each has. ``readable``: a zero for each bit but one,
    then the number's bits; else as ``gamma_encode``, which is as long.
    """
    size = bit_lengths(numbers)
    bits = 2 * size - 1
    upto, last = np.cumsum(bits), np.cumsum(sizes)
    row_bits = np.diff(upto[last - 1], prepend=0) if len(sizes) else np.empty(0, np.int64)
    row_ends = np.cumsum((row_bits + 7) // 8)
    starts = 8 * (row_ends - (row_bits + 7) // 8)
    ends = upto + np.repeat(starts - (np.cumsum(row_bits) - row_bits), sizes)
    out = np.zeros(8 * int(row_ends[-1]) if len(sizes) else 0, np.uint8)
    out[ends - size if readable else ends - bits] = 1  # the number's highest bit
    for k in range(int(size.max(initial=1)) - 1):
        here = np.flatnonzero(size > k + 1)
        out[ends[here] - 1 - k] = (numbers[here] >> k) & 1
    return np.packbits(out).tobytes(), row_ends, row_bits


def un_gamma_rows(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of many readable codes, one after another: data are bytes, starts where each list begins, counts their numbers.

    Where a code begins follows from the code before it. So for each bit the place after a code there is found at once, and
    that map, taken 1, 2, 4, ... times, gives twice as many beginnings of each list in each step.
    """
    bits = np.unpackbits(data)
    n = len(bits)
    one = np.minimum.accumulate(np.where(bits, np.arange(n), n)[::-1])[::-1]
    after = np.append(np.minimum(2 * one - np.arange(n) + 1, n), n)
    kept = counts > 0
    at, left, step = starts[kept] * 8, counts[kept], 1  # left: numbers from here to the list's end
    while len(more := np.flatnonzero(left > step)):
        at, left, step = np.concatenate((at, after[at[more]])), np.concatenate((left, left[more] - step)), 2 * step
        after = after[after]
    at.sort()
    if len(at) and at[-1] >= n:
        raise ValueError("the codes end before their count")
    begin = one[at]
    size, out = begin - at + 1, np.ones(len(at), np.int64)
    for k in range(1, int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        out[here] = out[here] << 1 | bits[begin[here] + k]
    return out


def elias_array(numbers: np.ndarray) -> bytes:
    """Gamma codes that can be read back: a zero for each bit but one, then the number's bits. As long as ``gamma_encode``'s."""
    n = numbers.astype(np.int64)
    return gamma_rows(n, np.array([len(n)]), True)[0] if len(n) else b""


def un_elias_array(data: bytes, count: int) -> list[int]:
    """The first ``count`` numbers: a run of zeros says how many bits follow its one."""
    return un_gamma_rows(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([count])).tolist()

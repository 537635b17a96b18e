"""Counting quotient filters: lossless counters of whole numbers of up to 126 bits, kept as bytes.

A key is permuted by an invertible Feistel network over its two halves, so keys of any pattern spread evenly. The first
bits of the permuted key are its quotient, all others its remainder; nothing is cut off, so a filter gives its keys back.
Stored are, per quotient, the length of its run in unary (about two bits a key), the remainders in order, and the
counters (one byte, larger ones apart). Filters are sorted by the permuted key: merging two is merging sorted lists, and
a range of quotients of many filters can be merged without looking at the rest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

U = np.uint64
ROUNDS = 4
_HEAD = "<QBBB"


def masked(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def halves(width: int) -> tuple[int, int]:
    """Bits of the left and of the right half of a key."""
    return width - width // 2, width // 2


def _round(x: np.ndarray, i: int, bits: int) -> np.ndarray:
    """`bits` well-mixed bits of x, another function for each i."""
    h = (x + U(2 * i + 1)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h & masked(bits)


def permute(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = halves(width)
    for i in range(0, ROUNDS, 2):
        left = left ^ _round(right, i, a)
        right = right ^ _round(left, i + 1, b)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What `permute` was given."""
    a, b = halves(width)
    for i in reversed(range(0, ROUNDS, 2)):
        right = right ^ _round(left, i + 1, b)
        left = left ^ _round(right, i, a)
    return left, right


def packed(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keys of `bits` bits an id, the first id in front."""
    width = bits * len(ids)
    a, b = halves(width)
    left, right = np.zeros(len(ids[0]), U), np.zeros(len(ids[0]), U)
    for i, x in enumerate(ids):
        x, low = x.astype(U), width - bits * (i + 1)  # lowest bit of this id in the key
        if low >= b:
            left |= x << U(low - b)
        else:
            right |= (x << U(low)) & masked(b)
            if low + bits > b:
                left |= x >> U(b - low)
    return left, right


def unpacked(left: np.ndarray, right: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    width = bits * n
    b, out = halves(width)[1], []
    for i in range(n):
        low = width - bits * (i + 1)
        if low >= b:
            x = left >> U(low - b)
        else:
            x = right >> U(low)
            if low + bits > b:
                x = x | left << U(b - low)
        out.append((x & masked(bits)).astype(np.int64))
    return out


def _planes(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _unplanes(raw: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : -(-bits // 8)] = np.frombuffer(raw, np.uint8).reshape(n, -(-bits // 8))
    return out.reshape(-1).view("<u8").astype(U)


class Counts:
    """Counters of permuted keys in order. `a` and `b` are the bits of the halves; a range of a filter has fewer in the left one."""

    def __init__(self, left: np.ndarray, right: np.ndarray, count: np.ndarray, a: int, b: int) -> None:
        self.left, self.right, self.count, self.a, self.b = left, right, count, a, b

    def __len__(self) -> int:
        return len(self.count)

    @classmethod
    def of(cls, left: np.ndarray, right: np.ndarray, count: np.ndarray, a: int, b: int) -> Counts:
        """From permuted keys in any order, repeated or not."""
        if not len(left):
            return cls(left, right, count.astype(np.int64), a, b)
        if a + b <= 64:  # one number orders like both halves
            return cls._of_one(left << U(b) | right if b else left, count, a, b)
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        return cls(left[new], right[new], np.add.reduceat(count[order].astype(np.int64), new), a, b)

    @classmethod
    def _of_one(cls, one: np.ndarray, count: np.ndarray, a: int, b: int) -> Counts:
        """From keys as one number each."""
        order = np.argsort(one, kind="stable")
        one, count = one[order], count[order].astype(np.int64, copy=False)
        del order
        new = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        one, count = one[new], np.add.reduceat(count, new)
        return cls(one >> U(b) if b else one, one & masked(b), count, a, b)

    @classmethod
    def of_each(cls, left: np.ndarray, right: np.ndarray, a: int, b: int) -> Counts:
        """From permuted keys in any order, each counted once for every time it is there."""
        if a + b > 64 or not len(left):
            return cls.of(left, right, np.ones(len(left), np.int64), a, b)
        one = np.sort(left << U(b) | right)
        new = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        count, one = np.diff(new, append=len(one)), one[new]
        return cls(one >> U(b), one & masked(b), count, a, b)

    @classmethod
    def merged(cls, parts: list[Counts]) -> Counts:
        a, b = parts[0].a, parts[0].b
        parts = [p for p in parts if len(p)] or parts[:1]
        if len(parts) == 1:
            return parts[0]
        count = np.concatenate([p.count for p in parts])
        if a + b <= 64:
            return cls._of_one(np.concatenate([p.left << U(b) | p.right if b else p.left for p in parts]), count, a, b)
        return cls.of(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("left", "right")), count, a, b)

    def ranges(self, bits: int) -> list[tuple[int, Counts]]:
        """(number, part) for each of the 2**bits ranges of quotients that has keys; a part's keys lose these first bits."""
        shift = U(self.a - bits)
        top = (self.left >> shift).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)]
        rest = self.left & masked(self.a - bits)
        return [
            (int(top[i]), Counts(rest[i:j], self.right[i:j], self.count[i:j], self.a - bits, self.b))
            for i, j in zip(cuts, cuts[1:], strict=False) if j > i]

    def to_bytes(self) -> bytes:
        n = len(self.count)
        q = min(self.a, max(0, n.bit_length() - 1))
        quotient = (self.left >> U(self.a - q)).astype(np.int64)
        unary = np.zeros(n + (1 << q), np.uint8)
        unary[quotient + np.arange(n)] = 1  # a one for each key, a zero at the end of each quotient's run
        rest, bits = self.left & masked(self.a - q), self.a - q
        if bits + self.b <= 64:
            rest, bits = (rest << U(self.b) | self.right if self.b else rest), bits + self.b
            body = _planes(rest, bits)
        else:
            body = _planes(rest, bits) + _planes(self.right, self.b)
        small, large = np.minimum(self.count, 255).astype(np.uint8), self.count[self.count >= 255]
        return b"".join((struct.pack(_HEAD, n, q, self.a, self.b), np.packbits(unary).tobytes(), body, small.tobytes(), large.astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Counts:
        n, q, a, b = struct.unpack_from(_HEAD, raw)
        raw, at = memoryview(raw), struct.calcsize(_HEAD)

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return raw[at - size : at]

        unary = np.unpackbits(np.frombuffer(take(-(-(n + (1 << q)) // 8)), np.uint8), count=n + (1 << q))
        quotient = (np.flatnonzero(unary) - np.arange(n)).astype(U)
        bits = a - q
        if bits + b <= 64:
            rest = _unplanes(take(n * -(-(bits + b) // 8)), n, bits + b)
            rest, right = (rest >> U(b), rest & masked(b)) if b else (rest, np.zeros(n, U))
        else:
            rest = _unplanes(take(n * -(-bits // 8)), n, bits)
            right = _unplanes(take(n * -(-b // 8)), n, b)
        count = np.frombuffer(take(n), np.uint8).astype(np.int64)
        count[count == 255] = np.frombuffer(take(8 * int((count == 255).sum())), "<i8")
        return cls(quotient << U(bits) | rest if bits < 64 else rest, right, count, a, b)


class Pile:
    """Filters of one range that wait to be merged, cut into 2**cut smaller ranges: nine bytes a key or so, not decoded ones."""

    def __init__(self, cut: int) -> None:
        self.cut, self.parts = cut, {}
        self.a = self.b = 0

    def add(self, counts: Counts) -> None:
        self.a, self.b = counts.a, counts.b
        for k, part in counts.ranges(min(self.cut, counts.a)):
            small = part.count.astype(np.min_scalar_type(int(part.count.max())))
            keys = (part.left << U(part.b) | part.right if part.b else part.left,) if part.a + part.b <= 64 else (part.left, part.right)
            self.parts.setdefault(k, []).append((keys, small))

    def merged(self) -> Iterator[Counts]:
        """The sums, one smaller range after the other; each is forgotten as it is given."""
        cut = min(self.cut, self.a)
        a, b = self.a - cut, self.b
        for k in sorted(self.parts):
            held = self.parts.pop(k)
            count = np.concatenate([c.astype(np.int64) for _, c in held])
            keys = [np.concatenate(x) for x in zip(*(x for x, _ in held), strict=True)]
            del held
            sums = Counts._of_one(keys[0], count, a, b) if len(keys) == 1 else Counts.of(*keys, count, a, b)
            yield Counts(sums.left | (U(k) << U(a) if a < 64 else U(0)), sums.right, sums.count, self.a, b)

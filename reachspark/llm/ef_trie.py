"""A compact n-gram trie: Elias-Fano levels and pointers, quantised probabilities, one flat buffer.

Level ``j`` holds the j-th words of all n-grams, each context's successors in ascending order. Adding
to each successor the last value of the context before makes a whole level increase, so it takes
``2 + log2(universe / n)`` bits an entry. Where a context's successors begin is a second increasing sequence.
A look-up walks down from the root: pointers give the range of successors, the entry before the
range gives the amount to add, and a successor search in that range gives the entry. Everything works on whole arrays.
"""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64
_EACH, _TOP = _U(0x0101010101010101), _U(0x8080808080808080)
#: Position of the r-th set bit of a byte.
_NTH = np.array([[*[i for i in range(8) if b >> i & 1], *[0] * 8][:8] for b in range(256)], np.uint8)
_CHUNK = 1 << 16

#: A probability p is the code ceil(-log10(p) * STEP): 16 bits for sixteen decades, never rounded up.
STEP, ABSENT = 4096, 0xFFFF
_DECODED = np.append(10.0 ** (-np.arange(ABSENT) / STEP), 0.0)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; a decoded one is at most its original and 0.06 % below it, or 0 below 1e-16."""
    code = np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEP - 1e-9)
    return np.clip(code, 0, ABSENT).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return _DECODED[code]


def _byte_counts(words: np.ndarray) -> np.ndarray:
    """Set bits of a word's first byte, first two bytes, ... in its eight bytes."""
    x = words - (words >> _U(1) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + (x >> _U(2) & _U(0x3333333333333333))
    return ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH


def ef_arrays(values: np.ndarray) -> dict[str, np.ndarray]:
    """Parts of a non-decreasing sequence: packed low bits, unary high bits, and counts of set bits."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = min(max(0, (top // max(n, 1)).bit_length() - 1), 56)  # read from eight bytes at any bit
    values = values.astype(np.uint64)
    lows = np.zeros((n, low_bits), np.uint8)
    for j in range(low_bits):
        lows[:, j] = values >> np.uint64(j) & np.uint64(1)
    at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(-(-(n + (top >> low_bits) + 2) // 64) * 64, np.uint8)
    high[at] = 1
    high = np.packbits(high, bitorder="little").view("<u8")
    ones = np.concatenate(([0], np.cumsum(_byte_counts(high) >> _U(56)))).astype(np.uint32 if n < 1 << 32 else np.int64)
    low = np.concatenate((np.packbits(lows.ravel(), bitorder="little"), np.zeros(8, np.uint8)))
    return {"low": low, "high": high, "ones": ones, "size": np.array([n, low_bits, top], np.int64)}


class Increasing:
    """Random access and successor search in an Elias-Fano sequence."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits, self.top = (int(x) for x in parts["size"])
        low = parts["low"]
        self.words = np.ndarray((len(low) - 7,), np.dtype("<u8"), low, strides=(1,))
        self.high = parts["high"]
        self.ones = parts["ones"].astype(np.int64)
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Bit position of the k-th set (or unset) high bit."""
        out = np.empty(len(k), np.int64)
        before = self.zeros if zeros else self.ones
        for a in range(0, len(k), _CHUNK):
            want = k[a : a + _CHUNK]
            block = np.searchsorted(before, want, "right") - 1
            data = self.high[block]
            data = ~data if zeros else data
            rest = (want - before[block]).astype(np.uint64)
            upto = _byte_counts(data)
            # bytes whose count does not exceed the rest
            byte = ((((rest * _EACH) | _TOP) - (upto & ~_TOP)) & _TOP) >> _U(7)
            byte = (byte * _EACH) >> _U(56)
            rest -= np.where(byte > 0, upto >> (byte - _U(1) & _U(7)) * _U(8) & _U(0xFF), _U(0))
            inside = (data >> byte * _U(8) & _U(0xFF)).astype(np.int64)
            out[a : a + _CHUNK] = block * 64 + (byte * _U(8)).astype(np.int64) + _NTH[inside, rest.astype(np.int64)]
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        return (self._select(i, False) - i << self.low_bits) + self._low(i)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions of values inside ``[begin, end)``, -1 where absent: the first entry not below, if equal."""
        out = np.full(len(value), -1, np.int64)
        ask = np.flatnonzero((value >= 0) & (value <= self.top) & (begin < end))
        v, low = value[ask], value[ask] & ((1 << self.low_bits) - 1)
        bucket = v >> self.low_bits
        a = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), True) - bucket + 1, 0)
        a, last = np.maximum(a, begin[ask]), np.minimum(self._select(bucket, True) - bucket, end[ask])
        b = np.maximum(last, a)
        while (a < b).any():
            mid = (a + b) >> 1
            small = (a < b) & (self._low(np.minimum(mid, self.n - 1)) < low)
            a, b = np.where(small, mid + 1, a), np.where(small, b, np.maximum(mid, a))
        here = a < last
        here[here] = self._low(a[here]) == low[here]
        out[ask[here]] = a[here]
        return out


def trie_arrays(columns: list[np.ndarray]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Levels of sorted distinct n-grams (columns of word ids), and the first n-gram of every entry, level by level."""
    out: dict[str, np.ndarray] = {}
    m = len(columns[0])
    new = np.zeros(m, bool)
    new[:1] = True
    parent_first = np.zeros(1 if m else 0, np.int64)
    firsts = []
    for j, column in enumerate(columns):
        new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        ids = column[first]
        if j == 0:
            values = ids
        else:
            begin = np.searchsorted(first, parent_first)
            last = np.append(begin[1:], len(first)) - 1
            added = np.concatenate(([0], np.cumsum(ids[last] + 1)))[:-1] if len(begin) else begin
            values = ids + 1 + np.repeat(added, last + 1 - begin)
            out |= {f"p{j}.{k}": v for k, v in ef_arrays(np.append(begin, len(first))).items()}
        out |= {f"v{j}.{k}": v for k, v in ef_arrays(values).items()}
        parent_first = first
        firsts.append(first)
    return out, firsts


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One buffer: a table of contents, then the arrays at multiples of eight bytes."""
    at, contents, body = 0, {}, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        contents[name] = [a.dtype.str, at, len(a)]
        data += bytes(-len(data) % 8)
        body.append(data)
        at += len(data)
    head = json.dumps(contents).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def from_buffer(buffer) -> dict[str, np.ndarray]:
    """Views of the arrays of a buffer or memory map; nothing is copied."""
    size = int.from_bytes(bytes(buffer[:8]), "little")
    contents = json.loads(bytes(buffer[8 : 8 + size]))
    return {name: np.frombuffer(buffer, np.dtype(kind), n, 8 + size + at) for name, (kind, at, n) in contents.items()}


class Trie:
    """Look-ups in the arrays of :func:`trie_arrays` under a name prefix."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str, order: int):
        def part(name: str) -> Increasing:
            start = f"{prefix}{name}."
            return Increasing({k[len(start) :]: v for k, v in arrays.items() if k.startswith(start)})

        self.values = [part(f"v{j}") for j in range(order)]
        self.pointers = [None, *[part(f"p{j}") for j in range(1, order)]]

    def find(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Entries of n-grams at every level, -1 from the first absent word on."""
        first = columns[0]
        node = self.values[0].find(first, np.zeros_like(first), np.full_like(first, self.values[0].n))
        path = [node]
        for level, pointer, column in zip(self.values[1:], self.pointers[1:], columns[1:], strict=True):
            known = np.flatnonzero((node >= 0) & (column >= 0))
            # every context is asked once
            context, back = np.unique(node[known], return_inverse=True)
            begin, end = pointer.access(context), pointer.access(context + 1)
            base = np.where(begin > 0, level.access(np.maximum(begin - 1, 0)), 0)
            node = np.full(len(column), -1, np.int64)
            node[known] = level.find((base + 1)[back] + column[known], begin[back], end[back])
            path.append(node)
        return path

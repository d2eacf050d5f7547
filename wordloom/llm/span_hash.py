"""Slices of one byte string as numbers: the whole bytes of short ones, so that equal numbers mean equal slices.

A slice of up to 16 bytes is its two halves as 64-bit numbers and its length; nothing is hashed away. Longer slices are
rare in texts and are looked up by their bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHORT = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all 64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def halves(blob: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 8 bytes, next 8 bytes, length) of each blob[start:stop]; of longer ones the first 16 bytes."""
    padded = blob + bytes(SHORT + 8)
    at = np.ndarray((len(blob) + SHORT + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each place on
    length = stops - starts
    return at[starts] & _MASKS[np.minimum(length, 8)], at[starts + 8] & _MASKS[np.clip(length - 8, 0, 8)], length


def spread(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each short slice."""
    return mixed(mixed(low + np.uint64(0x9E3779B97F4A7C15)) ^ mixed(high + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def word_hashes(blob: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, by its numbers where it is short, else by XXH3 of its bytes."""
    low, high, length = halves(blob, starts, stops)
    out = spread(low, high, length)
    for k in np.flatnonzero(length > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(blob[starts[k] : stops[k]])
    return out


#: Bytes that long slices may take as keys, and what each takes besides its own bytes.
LONG_BYTES, LONG_ENTRY = 16 << 20, 150


class Places:
    """A table of slices' codes in a fixed number of places (a power of two): a new slice takes the place of another. Long ones have a dictionary, begun anew when it has more than `most_long` bytes."""

    def __init__(self, places: int, most_long: int = LONG_BYTES):
        self.low, self.high = np.zeros(places, dtype=np.uint64), np.zeros(places, dtype=np.uint64)
        self.length, self.code = np.zeros(places, dtype=np.uint8), np.full(places, -1, dtype=np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes, self.most_long = 0, most_long

    def find(self, blob: bytes, starts: np.ndarray, stops: np.ndarray, learn) -> np.ndarray:
        """Codes of the slices; learn(slices) gives those of slices that are not there."""
        low, high, length = halves(blob, starts, stops)
        slot = (spread(low, high, length) & np.uint64(len(self.code) - 1)).astype(np.int64)
        same = (self.low[slot] == low) & (self.high[slot] == high) & (self.length[slot] == length)
        codes = np.where(same, self.code[slot], -1).astype(np.int64)
        missing = np.flatnonzero((codes < 0) & (length <= SHORT))
        if len(missing):
            both = np.empty(len(missing), dtype=[("low", np.uint64), ("high", np.uint64), ("length", np.int64)])
            both["low"], both["high"], both["length"] = low[missing], high[missing], length[missing]
            _, one, which = np.unique(both, return_index=True, return_inverse=True)
            kept = missing[one]
            codes[missing] = learn([blob[a:b] for a, b in zip(starts[kept].tolist(), stops[kept].tolist())])[which]
            at = slot[kept]
            self.low[at], self.high[at], self.length[at], self.code[at] = low[kept], high[kept], length[kept], codes[kept]
        many = np.flatnonzero(length > SHORT)
        if len(many):
            slices = [blob[a:b] for a, b in zip(starts[many].tolist(), stops[many].tolist())]
            new = [x for x in dict.fromkeys(slices) if x not in self.long]
            if new:
                self.long.update(zip(new, learn(new).tolist()))
                self.long_bytes += sum(map(len, new)) + LONG_ENTRY * len(new)
            codes[many] = [self.long[x] for x in slices]
            if self.long_bytes > self.most_long:
                self.forget_long()
        return codes

    def forget_long(self) -> None:
        self.long, self.long_bytes = {}, 0

    def forget_all(self) -> None:
        self.code[:] = -1
        self.forget_long()

    def renumber(self, keep_first: bool = False) -> np.ndarray:
        """Numbers the codes in use from 0 on (code 0 stays with keep_first); returns the old codes in their new order."""
        used, held = self.code >= 0, list(self.long)
        all_codes = np.concatenate([self.code[used], np.fromiter(self.long.values(), dtype=np.int64, count=len(held)), np.zeros(int(keep_first), dtype=np.int64)])
        live, now = np.unique(all_codes, return_inverse=True)
        n = int(used.sum())
        self.code[used] = now[:n]
        self.long = dict(zip(held, now[n : n + len(held)].tolist()))
        return live.astype(np.int64)

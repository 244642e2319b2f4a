"""Vectorised text primitives over Arrow batches (numpy, no per-word Python).

A batch of texts becomes one flat array of bytes or code points; words are
[start, end) segments of it, and each word gets a 64-bit multilinear hash.
"""

from __future__ import annotations

import ctypes
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about so many bytes, which bounds the memory of a task.
CHUNK_BYTES = 2_000_000

#: Bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` reproducible 64-bit numbers."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * step)


_POWERS: dict[int, np.ndarray] = {}
_LETTERS: dict[int, np.ndarray] = {}


def _table(cache: dict, seed: int, n: int, salt: int) -> np.ndarray:
    if seed not in cache or len(cache[seed]) < n:
        cache[seed] = stream(max(n, 1024), seed * 7 + salt) | np.uint64(1)
    return cache[seed]


def hash_words(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int):
    """64-bit hashes of non-empty, ascending segments of ``units`` (bytes or code points), one array for each seed."""
    if not len(starts):
        out = [np.zeros(0, dtype=np.uint64) for _ in seeds]
        return out if len(seeds) > 1 else out[0]
    low, high = int(starts[0]), int(ends[-1])
    units, first, size = units[low:high], starts - low, (ends - starts).astype(np.uint64)
    stretch = np.diff(first, append=high - low)
    place = np.arange(high - low, dtype=np.int32) - np.repeat(first.astype(np.int32), stretch)
    gaps = not np.array_equal(ends[:-1], starts[1:])
    if gaps:  # sums over the segments and over what is between them
        first = np.stack([first, ends - low], axis=1).ravel()[:-1]
    out = []
    for seed in seeds:
        powers = _table(_POWERS, seed, int(stretch.max()), 1)
        letters = _table(_LETTERS, seed, int(units.max()) + 1, 2)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(letters[units] * powers[place], first)
            out.append(mix((total[::2] if gaps else total) + size))
    return out if len(seeds) > 1 else out[0]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(batch: pa.RecordBatch, col: str, most: int = CHUNK_BYTES):
    """Slices of the batch whose texts have about ``most`` bytes together."""
    texts = batch.column(batch.schema.get_field_index(col))
    _, o = flat(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(o, o[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back to the machine: a worker lives on beside later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def words_between(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs where ``space`` is false, cut at the offsets of texts."""
    n = len(space)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = word.copy()
    start[1:] &= space[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= space[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets into the words: those of text i are [out[i], out[i + 1])."""
    return np.searchsorted(starts, offsets, side="left")


#: The bytes of a word that are compared at once, eight to a number; longer words stand in a dictionary.
KEY_BYTES = 24
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_keys(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first ``KEY_BYTES`` bytes of each word, as numbers of eight bytes, zeros behind its end."""
    padded = np.concatenate([data, np.zeros(KEY_BYTES + 8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = [eight[starts] & _MASK[np.minimum(size, 8)]]
    for at in range(8, KEY_BYTES, 8):
        longer = np.flatnonzero(size > at)
        key = np.zeros(len(starts), np.uint64)
        key[longer] = eight[starts[longer] + at] & _MASK[np.minimum(size[longer] - at, 8)]
        out.append(key)
    return out


class WordTable:
    """Lists of ids by word (bytes), looked up for all words of a batch at once; emptied when full, so its memory is bounded.

    An open-addressing table of 64-bit hashes gives a word's place; the word's bytes and
    length are then compared with those of the place, so equal hashes are never taken
    for equal words.  Words of more than ``KEY_BYTES`` bytes, and those whose hash
    another word has, stand in a dictionary.
    """

    def __init__(self, most: int):
        self.most, self.mask = most, np.uint64((1 << (4 * most - 1).bit_length() - 1) - 1)
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(int(self.mask) + 1, np.uint64)  # the upper half of a hash, and a place from 1 on
        self.n, self.odd = 0, {}
        self.keys, self.size = [np.zeros(self.most, np.uint64) for _ in range(0, KEY_BYTES, 8)], np.zeros(self.most, np.int32)
        self.out, self.offs = np.zeros(1 << 16, np.uint32), np.zeros(self.most + 1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """A place that half of each hash has, or -1."""
        out = np.full(len(h), -1, np.int32)
        at, slot, mark = None, h & self.mask, h >> np.uint64(32)
        while len(slot):
            seen = self.slots[slot]
            hit = (seen >> np.uint64(32)) == mark
            hit &= seen != 0
            found = np.flatnonzero(hit)
            out[found if at is None else at[found]] = (seen[found] & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
            go = np.flatnonzero(~hit & (seen != 0))
            at, slot, mark = go if at is None else at[go], (slot[go] + np.uint64(1)) & self.mask, mark[go]
        return out

    def _put(self, h: np.ndarray, places: np.ndarray) -> None:
        """Enter hashes of which no two, and none of the table's, share a half."""
        slot, value = h & self.mask, (h >> np.uint64(32) << np.uint64(32)) | (places + 1).astype(np.uint64)
        while len(slot):
            free = np.flatnonzero(self.slots[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            now = free[first]
            self.slots[slot[now]] = value[now]
            left = np.ones(len(slot), dtype=bool)
            left[now] = False
            slot, value = (slot[left] + np.uint64(1)) & self.mask, value[left]

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> np.ndarray:
        """The place of each word, ``most`` at most; ``make`` gives the ids of words that are new: lists, or all in turn and how many each has."""
        size = (ends - starts).astype(np.int32)
        keys = word_keys(data, starts, size)
        h = key_hash(keys, size)
        out = self._find(h)
        odd = (self.size[out] != size) | (self.keys[0][out] != keys[0]) | (size > KEY_BYTES)  # and those with no place
        for k in range(1, len(keys)):
            longer = np.flatnonzero((size > 8 * k) & ~odd)
            odd[longer] = self.keys[k][out[longer]] != keys[k][longer]
        out[odd] = -1
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out
        text = data.tobytes()
        words = [text[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
        kinds = dict(zip(dict.fromkeys(words), count()))
        which = np.fromiter(map(kinds.get, words), np.int64, len(words))
        place = np.fromiter(map(self.odd.get, kinds, repeat(-1)), np.int64, len(kinds))
        new = np.flatnonzero(place < 0)
        if self.n + len(new) > self.most:
            self.clear()
            return self.places(data, starts, ends, make)
        place[new] = self.n + np.arange(len(new))
        names = list(kinds) if len(new) == len(kinds) else [w for w, k in zip(kinds, place.tolist(), strict=True) if k >= self.n]
        # of the new words, short ones whose hash nothing else has go into the table
        first = miss[np.unique(which, return_index=True)[1][new]]
        _, back, times = np.unique(h[first] >> np.uint64(32), return_inverse=True, return_counts=True)
        free = (times[back] == 1) & (self._find(h[first]) < 0) & (size[first] <= KEY_BYTES)
        for mine, key in zip(self.keys, keys, strict=True):
            mine[place[new]] = key[first]
        self.size[place[new]] = size[first]
        self._put(h[first[free]], place[new[free]])
        self.odd.update((names[i], int(place[new[i]])) for i in np.flatnonzero(~free).tolist())
        made = make(names)
        if not isinstance(made, tuple):
            made = np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))
        self.out = _grown(self.out, int(self.offs[self.n]), made[0])
        self.offs[self.n + 1 : self.n + len(new) + 1] = self.offs[self.n] + np.cumsum(made[1])
        self.n += len(new)
        out[miss] = place[which]
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has; as many words at once as the table holds."""
        found = []
        for at in range(0, len(starts), self.most):
            w = self.places(data, starts[at : at + self.most], ends[at : at + self.most], make)
            first = self.offs[w]
            size = (self.offs[w + 1] - first).astype(np.int32)
            take = np.repeat(first.astype(np.int32) - (np.cumsum(size, dtype=np.int32) - size), size)
            take += np.arange(len(take), dtype=np.int32)
            found.append((self.out[take], size))
        if not found:
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def key_hash(keys: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and length, never 0."""
    with np.errstate(over="ignore"):
        h = mix(keys[0] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k, key in enumerate(keys[1:], 1):
            longer = np.flatnonzero(size > 8 * k)
            h[longer] = mix(h[longer] ^ key[longer])
    return h | np.uint64(1)


def as_bytes(units: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
    """The code points in UTF-8, and places among them as places among the bytes."""
    if not len(units) or units.max() < 0x80:
        return units.astype(np.uint8), *places
    data = np.frombuffer(units.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    more = (units >= 0x80).view(np.uint8)
    if len(data) > len(units) + int(np.count_nonzero(more)):
        more = more + (units >= 0x800).view(np.uint8) + (units >= 0x10000).view(np.uint8)
    before = np.zeros(len(units) + 1, np.int32)
    np.cumsum(more, dtype=np.int32, out=before[1:])
    return data, *(p + before[p] for p in places)


def _grown(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``store`` with ``more`` after its first ``used``, in new memory where it doesn't fit."""
    if used + len(more) > len(store):
        store = np.concatenate([store[:used], np.zeros(used + 2 * len(more), store.dtype)])
    store[used : used + len(more)] = more
    return store


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the texts' offsets."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def all_below(units: np.ndarray, offs: np.ndarray, limit: int) -> list[bool]:
    """Whether each text of these code points has none from ``limit`` on."""
    out = np.ones(len(offs) - 1, dtype=bool)
    if len(units) and units.max() >= limit:
        out[np.searchsorted(offs, np.flatnonzero(units >= limit), side="right") - 1] = False
    return out.tolist()

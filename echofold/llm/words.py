"""Words and shingles of texts as 64-bit hashes, a batch of texts at a time in numpy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240917)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are hashed at a time; only a longer single word takes more.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 12)


def _of_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in bytes, and where each begins."""
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    table = _POWERS if longest <= len(_POWERS) else powers(longest)
    return mix64(np.add.reduceat(_BYTE[data[at]] * table[place], first)), starts


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """One hash for each maximal run of bytes other than space and 09-0D, in order."""
    whole = np.frombuffer(data, np.uint8)
    out, begin = [], 0
    while begin < len(whole):
        end = min(begin + CHUNK, len(whole))
        while end < len(whole) and not SPACE[whole[end]]:
            gap = np.flatnonzero(SPACE[whole[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(whole))
        block = whole[begin:end]
        out.append(_of_block(LOWER[block] if lower else block)[0])
        begin = end
    return np.concatenate(out) if len(out) != 1 else out[0]


def many_word_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """``word_hashes`` of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        data = np.frombuffer(b" ".join(group), np.uint8)
        hashes, starts = _of_block(LOWER[data] if lower else data)
        begins = np.cumsum([0] + [len(x) + 1 for x in group])
        cuts = np.searchsorted(starts, begins)
        out.extend(hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        group.clear()
        held = 0

    for text in texts:
        if len(text) > CHUNK // 4:
            flush()
            out.append(word_hashes(text, lower))
        else:
            group.append(text)
            held += len(text) + 1
            if held > CHUNK // 4:
                flush()
    flush()
    return out


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence where there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, mix64(np.array([size], np.uint64))[0])
    for k in range(size):
        total = total * np.uint64(_BASE) + words[k : k + n]
    return np.unique(mix64(total))

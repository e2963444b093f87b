"""Running Karp-Rabin hashes of words and word windows, over Arrow batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd, so that powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Texts are hashed in pieces of about so many characters, cut between words, whatever the length of a text.
PIECE = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (the three-step xor-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    step = base & MASK
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & MASK
    return out[:n]


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = powers(BASE, 2 * n), powers(pow(BASE, -1, 1 << 64), 2 * n)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _hash_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a blob, and their byte offsets."""
    raw = np.frombuffer(blob, np.uint8)
    inside = np.concatenate([[False], ~_spaces(raw), [False]])
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mix64((run[end] - run[start]) * down[start]), start


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at + 1, at + PIECE), text.rfind("\n", at + 1, at + PIECE))
        while cut <= at:  # one word longer than a piece stays whole
            spaces = [p for p in (text.find(" ", at + PIECE), text.find("\n", at + PIECE)) if p > 0]
            cut = min(spaces, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the offsets at which each text's words start (one more than texts)."""
    hashes, owners, held, owner_of, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal held, owner_of, size
        if held:
            blobs = [p.encode("utf-8", "replace") for p in held]
            h, start = _hash_blob(b"\n".join(blobs))
            ends = np.cumsum([len(b) + 1 for b in blobs])
            hashes.append(h)
            owners.append(np.asarray(owner_of)[np.searchsorted(ends, start, side="right")])
        held, owner_of, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > PIECE:
                flush()
            held.append(piece)
            owner_of.append(i)
            size += len(piece)
    flush()
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + words[k:k + n]
    return mix64(out)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of every text, never across two texts, and their owners; a shorter text with words is one shingle."""
    counts = np.diff(bounds)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    windows = window_hashes(words, size)
    inside = owner[:len(windows)] == owner[size - 1:] if len(windows) else np.zeros(0, bool)
    out, out_owner = [windows[inside]], [owner[:len(windows)][inside]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[bounds[i]:bounds[i + 1]]
        out.append(window_hashes(w, len(w)))
        out_owner.append(np.array([i]))
    return np.concatenate(out), np.concatenate(out_owner)


def slices(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` characters together; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)

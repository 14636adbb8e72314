"""BLAKE3, a hash whose chunks can be hashed apart, over many chunks at once.

The chaining values of a byte range are those of the largest complete subtrees
in it, ``(level, index, value)``: a subtree of level k covers ``2**k`` chunks of
1 KiB. Ranges may be cut anywhere between chunks; ``combined`` gives the hash of
the whole from the nodes of all ranges, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CHUNK = 1024
#: Chunks that are compressed side by side.
_SIDE = 2048

# Fixed values of the published algorithm.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_PERMUTED = np.array([2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8])
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8

Node = tuple[int, int, bytes]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    a = a + b + x
    d = _turn(d ^ a, 16)
    c = c + d
    b = _turn(b ^ c, 12)
    a = a + b + y
    d = _turn(d ^ a, 8)
    c = c + d
    return a, _turn(b ^ c, 7), c, d


def _compress(values: np.ndarray, words: np.ndarray, counter: np.ndarray, length: int, flags: int) -> np.ndarray:
    """New chaining values, 8 x n, of n blocks side by side; ``words``: 16 x n."""
    n = words.shape[1]
    a, b = values[:4], values[4:]
    c = np.repeat(_IV[:4, None], n, 1)
    d = np.stack([counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), np.full(n, length, np.uint32), np.full(n, flags, np.uint32)])
    for step in range(7):
        if step:
            words = words[_PERMUTED]
        a, b, c, d = _mix(a, b, c, d, words[0:8:2], words[1:8:2])
        b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
        a, b, c, d = _mix(a, b, c, d, words[8:16:2], words[9:16:2])
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
    return np.concatenate([a ^ c, b ^ d])


def _chunk_values(pieces: Sequence[tuple[bytes, int, bool]]) -> np.ndarray:
    """Chaining values, 8 x n, of the chunks of all ``(data, first, root)``, numbered from ``first``; only a piece's last may be short."""
    counts = [chunks_of(len(data)) for data, _, _ in pieces]
    every = np.frombuffer(b"".join(data.ljust(n * CHUNK, b"\0") for (data, _, _), n in zip(pieces, counts, strict=True)), "<u4").reshape(-1, 16, 16)
    counter = np.concatenate([np.arange(first, first + n, dtype=np.uint64) for (_, first, _), n in zip(pieces, counts, strict=True)])
    root = np.repeat(np.where([r for _, _, r in pieces], _ROOT, 0), counts)
    length = np.full(len(every), CHUNK)
    length[np.cumsum(counts) - 1] = [len(data) - (n - 1) * CHUNK for (data, _, _), n in zip(pieces, counts, strict=True)]
    last = np.maximum(1, -(-length // 64)) - 1
    out = np.repeat(_IV[:, None], len(every), 1)
    for k in range(0, len(every), _SIDE):
        for block in range(last[k : k + _SIDE].max() + 1):
            on = k + np.flatnonzero(last[k : k + _SIDE] >= block)
            flags = (_CHUNK_START if block == 0 else 0) | np.where(last[on] == block, _CHUNK_END | root[on], 0)
            words = np.ascontiguousarray(every[on, block].T).astype(np.uint32)
            out[:, on] = _compress(out[:, on], words, counter[on], np.minimum(64, length[on] - 64 * block), flags)
    return out


def _parents(values: np.ndarray, root: np.ndarray | bool = False) -> np.ndarray:
    """Of neighbours, 8 x 2n, their parents, 8 x n."""
    words = np.concatenate([values[:, 0::2], values[:, 1::2]])
    n = words.shape[1]
    return _compress(np.repeat(_IV[:, None], n, 1), words, np.zeros(n, np.uint64), 64, np.where(root, _PARENT | _ROOT, _PARENT))


def _bytes(values: np.ndarray) -> list[bytes]:
    return [v.astype("<u4").tobytes() for v in values.T]


def chunks_of(size: int) -> int:
    return max(1, -(-size // CHUNK))


def ranges_nodes(ranges: Sequence[tuple[bytes, int, int]]) -> list[list[Node]]:
    """For each ``(data, first, total)`` the nodes of the chunks in ``data``, which begins with chunk ``first`` of a file of ``total`` chunks.

    All ranges are hashed side by side: a call of numpy costs the same for one short range as for hundreds.
    """
    if not ranges:
        return []
    out: list[list[Node]] = [[] for _ in ranges]
    values = _chunk_values([(data, first, total == 1) for data, first, total in ranges])
    edges = np.cumsum([chunks_of(len(data)) for data, _, _ in ranges])[:-1]
    held, level = [(k, first, own) for k, ((_, first, _), own) in enumerate(zip(ranges, np.split(values, edges, 1), strict=True))], 0
    while held:
        pairs = []
        for k, first, own in held:
            if first % 2:
                out[k].append((level, first, _bytes(own[:, :1])[0]))
                own, first = own[:, 1:], first + 1
            n = own.shape[1]
            if 2 << level >= ranges[k][2]:  # what stands above is the root
                out[k] += [(level, first + i, v) for i, v in enumerate(_bytes(own))]
                continue
            if n % 2:
                out[k].append((level, first + n - 1, _bytes(own[:, -1:])[0]))
                own = own[:, :-1]
            if own.shape[1]:
                pairs.append((k, first // 2, own))
        level += 1
        if pairs:
            above = _parents(np.concatenate([own for _, _, own in pairs], 1))
            edges = np.cumsum([own.shape[1] // 2 for _, _, own in pairs])[:-1]
            pairs = [(k, first, own) for (k, first, _), own in zip(pairs, np.split(above, edges, 1), strict=True)]
        held = pairs
    return out


def range_nodes(data: bytes, first: int, total: int) -> list[Node]:
    """The nodes of the chunks in ``data``, which begins with chunk ``first`` of a file of ``total`` chunks."""
    return ranges_nodes([(data, first, total)])[0]


def _joined(values: list[bytes], root: np.ndarray | bool = False) -> list[bytes]:
    """The parents of neighbours."""
    return _bytes(_parents(np.ascontiguousarray(np.frombuffer(b"".join(values), "<u4").astype(np.uint32).reshape(-1, 8).T), root))


def all_combined(files: Sequence[tuple[list[Node], int]]) -> list[bytes]:
    """For each ``(nodes, total)`` the hash of a file of ``total`` chunks from the nodes of ranges that cover it once; all side by side."""
    trees: list[dict[int, dict[int, bytes]]] = []
    for nodes, _ in files:
        trees.append(by := {})
        for level, index, value in nodes:
            by.setdefault(level, {})[index] = value
    for level in range(max((total for _, total in files), default=0).bit_length()):
        pairs = []
        for by, (_, total) in zip(trees, files, strict=True):
            own = by.get(level, {})
            if 2 << level < total:
                pairs += [(by, k, own.pop(k), own.pop(k + 1)) for k in sorted(own) if k % 2 == 0 and k + 1 in own]
        if pairs:
            for (by, k, _, _), value in zip(pairs, _joined([v for p in pairs for v in p[2:]]), strict=True):
                by.setdefault(level + 1, {})[k // 2] = value
    peaks = [[v for _, v in sorted((k << level, v) for level, own in by.items() for k, v in own.items())] for by in trees]
    while several := [p for p in peaks if len(p) > 1]:
        found = _joined([v for p in several for v in p[-2:]], np.array([len(p) == 2 for p in several]))
        for p, value in zip(several, found, strict=True):
            p[-2:] = [value]
    return [p[0] for p in peaks]


def combined(nodes: list[Node], total: int) -> bytes:
    """The hash of a file of ``total`` chunks from the nodes of ranges that cover it once, in any order."""
    return all_combined([(nodes, total)])[0]


def digest(data: bytes) -> bytes:
    """The hash of a whole text."""
    total = chunks_of(len(data))
    return combined(range_nodes(data, 0, total), total)

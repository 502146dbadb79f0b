"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, the first ``start`` bytes being known to agree."""
    i, n = start, min(len(a), len(b))
    while i < n and a[i : i + 16] == b[i : i + 16]:
        i += 16
    if i >= n:
        return n
    while i < n and a[i] == b[i]:
        i += 1
    return i


def front_code(ordered: Sequence[bytes]) -> tuple[bytes, bytes, bytes]:
    """(prefix lengths, lengths, remaining bytes) of sorted strings of at most 255 bytes."""
    lcps, rest, last = bytearray(), [], b""
    for s in ordered:
        n = common_prefix(last, s)
        lcps.append(n)
        rest.append(s[n:])
        last = s
    return bytes(lcps), bytes(map(len, ordered)), b"".join(rest)


def front_decode(lcps: bytes, lengths: bytes, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for n, total in zip(lcps, lengths, strict=True):
        last = last[:n] + rest[at : at + total - n]
        at += total - n
        out.append(last)
    return out


def merge_runs(runs: Sequence[tuple[Sequence[bytes], Sequence[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index in run, common prefix with the string before) of all strings, in order.

    Each run is its sorted strings and the prefix each shares with the one before it.  The
    tree keeps, for every loser, the prefix it shares with the string it lost to.  Against
    the same winner the longer shared prefix is the smaller string; only where these are
    equal are bytes compared, from there on, so no known prefix is compared again.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    strings = [r[0] for r in runs]
    shared = [r[1] for r in runs]
    at = [0] * k
    alive = [len(s) > 0 for s in strings]
    prefix = [0] * k
    losers = [-1] * (2 * size)

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; the one that loses gets its prefix with the other."""
        if b < 0 or not alive[b]:
            return True
        if a < 0 or not alive[a]:
            return False
        p, q = prefix[a], prefix[b]
        if p != q:
            return p > q
        x, y = strings[a][at[a]], strings[b][at[b]]
        n = common_prefix(x, y, p)
        if n == len(x) and n == len(y):
            first = a < b
        elif n == len(x):
            first = True
        elif n == len(y):
            first = False
        else:
            first = x[n] < y[n]
        prefix[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1)
    while winner >= 0 and alive[winner]:
        i = at[winner]
        yield winner, i, prefix[winner]
        i += 1
        at[winner] = i
        if i < len(strings[winner]):
            prefix[winner] = shared[winner][i]
        else:
            alive[winner] = False
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if other >= 0 and not beats(winner, other):
                losers[node], winner = winner, other
            node //= 2


def merged(runs: Sequence[tuple[Sequence[bytes], Sequence[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Order over the concatenation of the runs, and common prefixes with the string before."""
    heads = np.concatenate([[0], np.cumsum([len(s) for s, _ in runs])]).astype(np.int64)
    n = int(heads[-1])
    order, lcp = np.empty(n, np.int64), np.empty(n, np.int64)
    starts = heads.tolist()
    for j, (r, i, p) in enumerate(merge_runs(runs)):
        order[j] = starts[r] + i
        lcp[j] = p
    return order, lcp

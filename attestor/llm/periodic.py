"""Maximal periodic runs of words, found by an online sparse diagonal pass over each text.

Words that equal the word ``q`` before them lie on diagonal ``q``. The pass goes through the words
once and keeps, for each active lag, how long its diagonal has matched. A run with period ``q`` is
a diagonal of at least ``3 q`` matches, and of at least five, so a lag becomes active only at a
word whose five-word stretch has an earlier occurrence at that lag, looked up at every ``q``-th
word of a stretch of such words, and only if the diagonal reaches back ``q`` words. What is active
is therefore always a repetition, of which few overlap at any word; a diagonal that a smaller
active period explains is not followed. When a diagonal ends it is emitted at once if it is long enough.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from functools import cmp_to_key

import numpy as np
from pyspark.sql import DataFrame

from attestor.llm.common import per_row, texts
from attestor.llm.shingles import mixed

# fixed values of a run: least length, and how many periods it holds at least
LEAST, PERIODS = 6, 4
# fewest matches of a run's diagonal: LEAST - 1 with period 1
STRETCH = LEAST - 1
# up to so many words a diagonal is followed back from each, beyond that once for all
FEW = 16


def words(text: str | None) -> list[bytes]:
    """Maximal stretches of characters other than \\x20 and \\x09-\\x0D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbers(items: Sequence) -> np.ndarray:
    """Equal items get equal numbers."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in items), np.int64, len(items))


def _stretches(w: np.ndarray) -> np.ndarray:
    """A hash of the ``STRETCH`` words that end at each word; equal stretches have equal hashes."""
    u = w.astype(np.uint64)
    total = np.zeros(len(w) - STRETCH + 1, np.uint64)
    for k in range(STRETCH):
        total = mixed(total + u[k:len(w) - STRETCH + 1 + k] + np.uint64(1))
    return np.concatenate([np.arange(STRETCH - 1, dtype=np.uint64), total])


def _seen_before(h: np.ndarray) -> np.ndarray:
    """Whether the stretch ending at each word occurred earlier."""
    again = np.zeros(len(h), bool)
    order = np.argsort(h[STRETCH - 1:], kind="stable") + STRETCH - 1
    again[order[1:][h[order[1:]] == h[order[:-1]]]] = True
    return again


def _reach(w: np.ndarray, i: int, q: int) -> int:
    """How many words up to and with word ``i`` equal the word ``q`` before them."""
    n, step = 0, 64
    while True:
        top = i + 1 - n
        low = max(q, top - step)
        if low >= top:
            return n
        differs = np.flatnonzero(w[low:top] != w[low - q:top - q])
        if len(differs):
            return n + (top - low) - 1 - int(differs[-1])
        n, step = n + top - low, step * 4


def _starts(w: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
    """The first word of the diagonal with lag ``q`` that reaches each of the words ``at``, which ascend."""
    if len(at) <= FEW:
        return np.array([i + 1 - _reach(w, i, q) for i in at.tolist()])
    # one comparison of the whole stretch serves all
    low = int(at[0]) + 1 - _reach(w, int(at[0]), q)
    breaks = np.flatnonzero(w[low:at[-1] + 1] != w[low - q:at[-1] + 1 - q]) + low
    return np.concatenate(([low], breaks + 1))[np.searchsorted(breaks, at)]


def _entries(w: np.ndarray, h: np.ndarray, a: int, b: int) -> list[tuple[int, int, int]]:
    """(word, lag, first word of the diagonal) where a lag becomes active, by word.

    A stretch ending in ``a..b`` occurred before at the lag, which is looked up in steps of itself,
    and the diagonal reaches back as far as the lag. Multiples of a lag at which every stretch
    occurred are explained by it and left out.
    """
    out, whole = [], []
    for q in range(1, (b - a + STRETCH) // (PERIODS - 1) + 1):
        if any(q % p == 0 for p in whole):
            continue
        low = max(a, q + STRETCH - 1)
        # a run with a short period can be shorter than its step: look everywhere
        i = np.arange(low, b + 1, q if q > STRETCH else 1)
        at = i[h[i] == h[i - q]]
        if not len(at):
            continue
        if len(at) == len(i) and (h[low:b + 1] == h[low - q:b + 1 - q]).all():
            whole.append(q)
        start = _starts(w, q, at)
        long = at + 1 - start >= max(q, STRETCH)
        at, start = at[long], start[long]
        first = np.flatnonzero(np.diff(start, prepend=-1))
        out += zip(at[first].tolist(), [q] * len(first), start[first].tolist())
    return sorted(out)


def _scan(w: np.ndarray, h: np.ndarray, a: int, b: int, emit) -> None:
    """The online pass over the words ``a..b``, each of which ends a stretch seen before."""
    entries = _entries(w, h, a, b)
    if not entries:
        return
    word = w.tolist()
    active: dict[int, int] = {}
    k, i = 0, entries[0][0]
    while i < len(word) and (active or k < len(entries)):
        for q in [q for q in active if word[i] != word[i - q]]:
            emit(active.pop(q), i, q)
        while k < len(entries) and entries[k][0] == i:
            _, q, first = entries[k]
            k += 1
            if q not in active and not any(q % p == 0 and start <= i - q for p, start in active.items()):
                active[q] = first - q
        i += 1
    for q, start in active.items():
        emit(start, len(word), q)


def runs(items: Sequence) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period.

    A run is a stretch with smallest period ``q`` of at least ``max(6, 4 q)`` items that neither
    neighbour extends. Fewer than six items have none.
    """
    if len(items) < LEAST:
        return []
    w = numbers(items)
    h = _stretches(w)
    again = _seen_before(h)
    if not again.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], again, [False]))))
    best: dict[tuple[int, int], int] = {}

    def emit(start: int, end: int, q: int):
        if end - start >= max(LEAST, PERIODS * q):
            best[start, end] = min(q, best.get((start, end), q))

    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        _scan(w, h, a, b - 1, emit)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def collapsed(items: Sequence[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words with every run cut to its first period, joined by one blank."""
    gone = dropped(len(items), found)
    return b" ".join(x for x, lost in zip(items, gone.tolist()) if not lost)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; of equal ones the first, then that of the smallest period."""
    def order(x, y):
        return y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]
    return min(found, key=cmp_to_key(order)) if found else None


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period, text): every run of every text and the words of its first period."""
    def work(doc_id, text):
        w = words(text)
        return doc_id, [(s, n, q, b" ".join(w[s:s + q]).decode("utf-8", "replace")) for s, n, q in runs(w)]
    found = per_row(texts(docs), work, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint,text:string>>")
    return found.selectExpr("doc_id", "inline(runs)")


def clean(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each whole text with its runs cut to their first period; texts without a run stay as they are."""
    def work(doc_id, text):
        w = words(text)
        found = runs(w)
        return doc_id, collapsed(w, found).decode("utf-8", "surrogatepass") if found else text
    return per_row(texts(docs), work, "doc_id bigint, text string")


def planted(items: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the registered query plants by the checksum of the doc_id."""
    if doc_id is None or not items:
        return items
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(items)
    if h % 10:
        return items
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return items[:a] + [items[a + (i - a) % p] for i in range(a, n)]


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the strongest run, and checksums of all runs and of the rest.

    A null text has no words, and a document without a run has nulls for the strongest one. With a
    null doc_id nothing is planted. Every text is looked at whole, by itself, in the task that reads
    it; repeated rows give repeated results, an empty table none, and further columns play no part.
    """
    def work(doc_id, text):
        w = planted(words(text), doc_id)
        found = runs(w)
        top = strongest(found)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        start, length, q = top or (None, None, None)
        return (doc_id, len(found), start, length, q, 1000 * length // q if top else None,
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, found)).hexdigest())
    return per_row(texts(docs), work, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
                                      "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")

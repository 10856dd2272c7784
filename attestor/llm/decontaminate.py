"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of 13 words of the benchmark items; items with fewer words are one
pattern each. Patterns of one length m form a group. The search looks at the last two words (a
block) of the m words under its window: the shift table says how far the window may move before
any pattern can end in that block, and is m - 1 for blocks that no pattern has. Where the shift
is 0, the bucket of the block's hash lists the patterns that end in it, and comparing words
confirms or refutes each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import free_name, mapped, prepared, stored, texts

WINDOW = 13
BLOCK_BYTES = 2 << 20  # benchmark text searched for at once

# letters, digits and every byte of a non-ASCII character stay; A-Z become lower case
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Group:
    """The tables of all patterns with the same number of words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length, self.width = length, min(2, length)
        self.most = length - self.width + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.width, length + 1):
                block = pattern[end - self.width:end]
                self.shift[block] = min(self.shift.get(block, self.most), length - end)
            self.bucket[hash(pattern[-self.width:])].append((pattern, items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        length, width, shift, most = self.length, self.width, self.shift, self.most
        end, n = length, len(text)
        while end <= n:
            block = tuple(text[end - width:end])
            move = shift.get(block, most)
            if move:
                end += move
                continue
            for pattern, items in self.bucket[hash(block)]:
                if tuple(text[end - length:end]) == pattern:
                    yield end - length, items
            end += 1


def compiled(items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> list[Group]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, ws in items:
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            by_length[m][tuple(ws[i:i + m])].add(item)
    return [Group(m, patterns) for m, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_made: dict = {}


def _tables(sent, window: int) -> list[Group]:
    """The search tables of a broadcast block, made once in each worker process."""
    if _made.get("of") is not sent.value or _made["window"] != window:
        _made.update({"of": sent.value, "window": window,
                      "groups": compiled([(i, words(t)) for i, t in sent.value], window)})
    return _made["groups"]


def search(text: str | None, groups: list[Group]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """The number of words, the hit spans of words (merged, in order) and the items found."""
    ws = words(text)
    hits, items = [], set()
    for g in groups:
        for start, found in g.search(ws):
            hits.append((start, start + g.length))
            items |= found
    return len(ws), merged(sorted(hits)), items


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``, each small enough to be sent to every task."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def search_all(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, same, n_words, hits, items) for every document; ``same`` is a hash of its text.

    ``hits`` are merged spans of words inside occurrences, ``items`` the item_ids found, both
    over all blocks of the benchmark; a benchmark larger than one block is searched block by
    block and the parts meet by document. A null text has no words; a null item_id or item text
    is no item; an empty benchmark hits nothing. Repeated documents are searched each.
    """
    spark = prepared(docs.sparkSession)
    schema = ("doc_id bigint, same bigint, n_words bigint, hits array<struct<start: bigint, end: bigint>>, "
              "items array<bigint>")
    plain = texts(docs).select("doc_id", F.xxhash64("text").alias("same"), "text")

    def over(items: list) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(items)

        def work(rows):
            groups = _tables(sent, window)
            for doc_id, same, text in rows:
                n, hits, found = search(text, groups)
                yield doc_id, same, n, hits, sorted(found)
        return mapped(plain, work, schema), sent

    blocks = item_blocks(benchmark, block_bytes)
    first, _ = over(next(blocks))
    more = None
    for items in blocks:
        # the driver holds one block at a time: what it finds is written, then its broadcast goes
        found, sent = over(items)
        found = stored(found.filter(F.size("items") > 0), "benchmark-block")
        sent.destroy()
        more = found if more is None else more.unionByName(found)
    if more is None:
        return first
    # documents that a further block hits are added to the rows of the first block, which has every document
    more = (more.groupBy("doc_id", "same")
            .agg(F.flatten(F.collect_set("hits")).alias("more_hits"), F.flatten(F.collect_set("items")).alias("more_items")))
    both = first.alias("a").join(more.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.same = b.same"), "left")

    def join(rows):
        for doc_id, same, n, hits, items, more_hits, more_items in rows:
            spans = sorted((h["start"], h["end"]) for h in [*hits, *(more_hits or [])])
            yield doc_id, same, n, merged(spans), sorted({*items, *(more_items or [])})
    return mapped(both.select("a.doc_id", "a.same", "n_words", "hits", "items", "more_hits", "more_items"), join, schema)


def hit_words() -> Column:
    """How many words the hits cover."""
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["end"] - h["start"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are.

    A row goes by its own text, whatever its key: rows without a key, repeated rows and rows that
    share a key with others are judged one by one.
    """
    found = search_all(docs, benchmark).withColumn("n_hit", hit_words())
    gone = found.filter("n_hit > 0 AND 20 * n_hit >= n_words").select(F.col("doc_id").alias("gone_id"), "same").distinct()
    same = free_name([*docs.columns, "gone_id"], "same_text")
    rows = docs.withColumn(same, F.xxhash64("text"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows[same] == gone["same"]), "left_anti").select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the counts, the digest of its items and the verdict."""
    found = search_all(docs, benchmark)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(ids, 256).alias("items_sha256"))
            .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")))

"""Line deduplication against levelled sorted runs of line hashes.

The keys of the lines seen so far lie in runs: written tables of (128-bit hash, first holder),
sorted by hash. A batch of documents is merge-joined with the runs; keys that the runs hold are
repeats, the other keys of the batch form a new run on level 0. When a level has ``fanout``
runs, they are merged into one run of the next level, so that a key is rewritten only a
logarithmic number of times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import BLANKS, free_name, per_row, prepared, stored, texts

LEAST_CHARS = 10
BATCHES = 4
FANOUT = 3
NO_ID = (1 << 63) - 1  # a null key ranks after all others

_HASH = ["h1", "h2"]


def line_hash(line: str) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a key under 10 code points.

    The key is the line without blanks at its ends, with A-Z in lower case.
    """
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= LEAST_CHARS else None


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def line_keys(docs: DataFrame) -> DataFrame:
    """(d, h1, h2) for each different key of each document; d is the key of the document."""
    def work(d, text):
        return d, [_halves(h) for h in {line_hash(line) for line in (text or "").split("\n")} if h]
    plain = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "text")
    keys = per_row(plain, work, "d bigint, k array<struct<h1: bigint, h2: bigint>>")
    return keys.select("d", F.inline("k"))


@dataclass
class LineIndex:
    """The runs, by level. ``add`` takes one batch of (d, h1, h2) and returns what it must drop."""
    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> DataFrame | None:
        every = [run for level in self.levels for run in level]
        out = every[0] if every else None
        for run in every[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """(d, h1, h2): keys that document d must lose.

        A key that a run holds belongs to the holder written there; any other key to the
        smallest d of the batch. A document that comes again under the same d keeps its lines.
        """
        own = batch.groupBy(*_HASH).agg(F.min("d").alias("own"), F.max("d").alias("most"))
        seen = self.runs()
        if seen is None:
            owners = own.withColumn("holder", F.lit(None).cast("bigint"))
        else:
            owners = own.join(seen, _HASH, "left")
        owners = stored(owners, "line-owners")
        self._write(owners.filter("holder IS NULL").select(*_HASH, F.col("own").alias("holder")))
        shared = (owners.select(*_HASH, "most", F.coalesce("holder", "own").alias("holder"))
                  .filter("most <> holder").drop("most"))
        return batch.join(shared, _HASH).filter("d <> holder").select("d", *_HASH)

    def _write(self, run: DataFrame, level: int = 0) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        ordered = run.repartition(*_HASH).sortWithinPartitions(*_HASH)
        self.levels[level].append(stored(ordered, f"line-run-{level}"))
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            union = merged[0]
            for other in merged[1:]:
                union = union.unionByName(other)
            self._write(union, level + 1)


def dropped(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(d, h1, h2): per document the keys it must lose, batch after batch in the order of keys."""
    spark = docs.sparkSession
    keys = stored(line_keys(docs), "line-keys")
    shares = [i / batches for i in range(1, batches)]
    cuts = keys.agg(F.percentile_approx("d", shares, 1000)).first()[0] or []
    index, out = LineIndex(spark), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = keys
        if low is not None:
            part = part.filter(F.col("d") > low)
        if high is not None:
            part = part.filter(F.col("d") <= high)
        lost = stored(index.add(part), "line-drops")
        out = lost if out is None else out.unionByName(lost)
    return out


def deduplicate_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows with repeated lines left out of their text, and n_lines and n_dropped added.

    Lines are split at \\n; a null or empty text is one empty line. Lines whose key has at least
    10 code points and occurs in several documents stay only in the document with the smallest
    key, where all of them stay. Rows with equal keys count as one document; rows with a null
    key too, and they rank last. Columns named n_lines or n_dropped are replaced, all others stay
    as they are. An empty table gives no rows.
    """
    prepared(docs.sparkSession)
    plain = docs.drop("n_lines", "n_dropped")
    d_name, lost_name, counts_name = (free_name(plain.columns, n) for n in ("_d", "_lost", "_counts"))
    lost = (dropped(texts(docs, key, text), batches).groupBy(F.col("d").alias(d_name))
            .agg(F.collect_list(F.struct(*_HASH)).alias(lost_name)))  # at most a document's own lines
    both = (plain.withColumn(d_name, F.coalesce(key, F.lit(NO_ID))).join(lost, d_name, "left").drop(d_name)
            .withColumn(counts_name, F.lit(None).cast("struct<n_lines: bigint, n_dropped: bigint>")))
    at_text, at_lost = both.columns.index(text), both.columns.index(lost_name)

    def work(*row):
        kept, n, gone = without_lines(row[at_text], row[at_lost])
        return (*row[:at_text], kept, *row[at_text + 1:at_lost], None, (n, gone))
    done = per_row(both, work, both.schema.toDDL())
    return done.select(*plain.columns, F.col(counts_name)["n_lines"].alias("n_lines"), F.col(counts_name)["n_dropped"].alias("n_dropped"))


def without_lines(text: str | None, lost: list | None) -> tuple[str, int, int]:
    """The text without the lines of the lost keys, the number of its lines, how many are gone."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    gone = {(x["h1"], x["h2"]) for x in lost}
    kept = [x for x in lines if not ((h := line_hash(x)) and _halves(h) in gone)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts and the digest of the kept text."""
    found = deduplicate_rows(texts(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))

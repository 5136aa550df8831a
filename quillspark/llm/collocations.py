"""Phrase collocations: count-min sketches find what may be frequent, a second pass counts exactly that, then scores and subsumption.

1. Each task adds the words and word pairs of its texts to a count-min sketch of ``DEPTH`` rows. A run
   of blocks sends its part of the sketch as sorted cells with counts, in about a thousand shards; a shard's parts are added
   by one task one after the other in an array of fixed size (counts end at the threshold). The sketch's width follows the bytes
   of all texts, so cells stay lightly loaded at every size, and no task holds more of it than a shard.
   A second sketch takes the longer n-grams, of those words only whose neighbouring pairs may all be frequent by the first one.
2. Of a merged sketch only one bit for each cell is kept (estimate at least ``min_count``), and where the sketch is wider than
   ``2**bitmap_bits`` cells, one bit for each run of cells. These bitmaps are all that is broadcast: ``DEPTH * 2**bitmap_bits / 8``
   bytes at most for each (32 MB by default), whatever the corpus.
3. The last pass reads the texts again and counts, with their words, the n-grams whose bits are set in every row. An estimate is never below the
   true count, so nothing frequent is lost; what passes by chance is dropped by its exact count.
4. Scores, cuts and subsumption are joins and aggregates over the frequent n-grams, with decimals where products may pass 64 bits.

Words are ASCII-lower-cased, texts are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at ``[\\x20\\x09]``; everything is by language.

Defined results: a null or empty text has no words, a null language is ``und`` (and one with texts of the language named so); rows are
counted each by itself, repeated ones too; columns besides ``text`` and ``lang`` are ignored. An empty table gives no rows. A text longer than
``block_bytes`` is taken in parts that overlap by ``max_words - 1`` words; one word of any length is a word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm._spark import remove, written
from quillspark.llm._text import LOWER, distinct_words, gather, gram_hashes, mix, slices, word_hashes, words

DEPTH = 2
#: Cells that a task gathers before it sends them.
HELD = 4_000_000
#: Bytes of text for which a task counts, so that a phrase is sent once for as many places as possible.
TASK_BYTES = 1 << 27

BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False

_bitmaps: dict[str, list[np.ndarray]] = {}  # a worker unpacks a query's bitmap once


def _word_from(data: np.ndarray, at: int, nth: int = 1) -> int:
    """Where the ``nth`` word that begins at ``at`` or later begins; the end if there are fewer."""
    window, found = 1 << 16, 0
    while at < len(data):
        inside = INSIDE[data[at - 1 if at else 0 : at + window]]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + at if at else np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        if found + len(begins) >= nth:
            return int(begins[nth - found - 1])
        found += len(begins)
        at += window
        window = min(window * 2, 1 << 22)
    return len(data)


def blocks(column: pa.Array, size: int, max_words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, last row, lower-cased bytes, offsets, bytes whose n-grams count here) of about ``size`` bytes: a long text is cut before words, and each part brings the words behind it that its n-grams reach."""
    for first, last, data, offsets in slices(column, size):
        if last - first > 1 or len(data) <= size:
            yield first, last, LOWER[data], offsets, len(data)
            continue
        low = 0
        while low < len(data):
            high = _word_from(data, low + size)
            end = _word_from(data, high, max_words)
            yield first, last, LOWER[data[low:end]], np.array([0, end - low]), high - low
            low = high


class Block:
    """Words of a block, and which of them go on in the same piece (``joined``; ``only_pairs`` takes out pairs that are not frequent)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, limit: int):
        self.data = data
        self.starts, self.ends, self.row = words(data, offsets, INSIDE)
        self.own = int(np.searchsorted(self.starts, limit))  # n-grams that begin with these words count here
        breaks = np.cumsum(BREAK[data], dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        self.joined = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        self.hashes = word_hashes(data, self.starts, self.ends)

    def grams(self, n: int, salts: np.ndarray, beyond: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the n-grams that count here, or with ``beyond`` of all in the block; ``salts`` has a number for each row's language."""
        count = min(len(self.starts) - n + 1, len(self.starts) if beyond else self.own)
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = np.ones(count, dtype=bool)
        for j in range(n - 1):
            ok &= self.joined[j : j + count]
        at = np.flatnonzero(ok)
        return at, mix(gram_hashes(self.hashes, n, at) ^ salts[self.row[at]])

    def only_pairs(self, seen: Seen, salts: np.ndarray) -> None:
        """A phrase can be frequent only where each two neighbours in it are."""
        at, hashes = self.grams(2, salts, beyond=True)
        self.joined[:] = False
        self.joined[at[seen.test(hashes)]] = True


class Seen:
    """The bitmap of a merged sketch in every task."""

    def __init__(self, spark: SparkSession, shards: list, bits: int, bitmap_bits: int):
        self.name, self.bits, self.fold = uuid.uuid4().hex, bits, max(0, bits - bitmap_bits)
        self.bytes = max(1, (1 << (bits - self.fold)) // 8)
        self.held = spark.sparkContext.broadcast(_bitmap(shards, bits, bitmap_bits))

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """Whether an n-gram of each hash may be frequent."""
        if self.name not in _bitmaps:
            while len(_bitmaps) > 1:  # those of the query before
                del _bitmaps[next(iter(_bitmaps))]
            _bitmaps[self.name] = [np.frombuffer(pa.decompress(row, self.bytes, "zstd"), dtype=np.uint8) for row in self.held.value]
        ok = np.ones(len(hashes), dtype=bool)
        for depth, row in enumerate(_bitmaps[self.name]):
            cell = _cells(hashes, depth, self.bits) >> np.uint64(self.fold)
            ok &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return ok


def _cells(hashes: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return (hashes if depth == 0 else mix(hashes + np.uint64(depth))) >> np.uint64(64 - bits)


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for each row's language."""
    coded = langs.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def _packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells of a shard as differences by byte planes, then the counts, compressed."""
    planes = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes() + counts.tobytes(), "zstd", asbytes=True)


def _unpacked(n: int, body: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(body, n * (4 + kind.itemsize), "zstd"), dtype=np.uint8)
    planes = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(n)
    return np.cumsum(planes), raw[4 * n :].view(kind)


def _count_kind(min_count: int) -> np.dtype:
    """Counts of a part end at the threshold."""
    return np.dtype(np.uint8 if min_count < 256 else np.uint32)


def _shard_bits(bits: int) -> int:
    """About a thousand shards, of 65,536 to 16 million cells."""
    return min(bits, 24, max(16, bits - 10))


def sketch(documents: DataFrame, lengths: range, pairs: Seen | None, min_count: int, bits: int, bitmap_bits: int, block_bytes: int) -> DataFrame:
    """(depth, shard, bits): where the merged sketch of n-grams of these lengths reaches ``min_count``; shards are in order of cells."""
    shard_bits = _shard_bits(bits)
    kind = _count_kind(min_count)

    def part(depth: int, cells: np.ndarray) -> pa.RecordBatch:
        """A task's cells so far, each once with its count, by shard."""
        cells, counts = np.unique(cells, return_counts=True)
        counts = np.minimum(counts, min_count).astype(kind)
        shards = (cells >> cells.dtype.type(shard_bits)).astype(np.int64)
        cells = (cells & cells.dtype.type((1 << shard_bits) - 1)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        each = [(depth, int(shards[a]), b - a, _packed(cells[a:b], counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*each, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["depth", "shard", "n", "body"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        n = 0
        for batch in batches:
            salts = _salts(batch.column("lang"))
            for first, last, data, offsets, limit in blocks(batch.column("text"), block_bytes, lengths.stop):
                block = Block(data, offsets, limit)
                if pairs is not None:
                    block.only_pairs(pairs, salts[first:last])
                hashes = np.concatenate([block.grams(n, salts[first:last])[1] for n in lengths])
                for depth in range(DEPTH):
                    held[depth].append(_cells(hashes, depth, bits).astype(np.uint32 if bits <= 32 else np.uint64))
                n += len(hashes)
                if n > HELD:
                    yield from (part(depth, np.concatenate(held[depth])) for depth in range(DEPTH))
                    held, n = [[] for _ in range(DEPTH)], 0
        if n:
            yield from (part(depth, np.concatenate(held[depth])) for depth in range(DEPTH))

    fold = max(0, bits - bitmap_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come sorted: one shard is held at a time."""
        at, held = None, None

        def out() -> pa.RecordBatch:
            hot = held >= min_count
            hot = np.packbits(hot.reshape(-1, 1 << min(fold, shard_bits)).any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([pa.compress(hot.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["depth", "shard", "bits"])

        for batch in batches:
            for depth, shard, n, body in zip(*(batch.column(c).to_pylist() for c in ("depth", "shard", "n", "body")), strict=True):
                if at != (depth, shard):
                    if at is not None:
                        yield out()
                    at, held = (depth, shard), np.zeros(1 << shard_bits, dtype=np.uint32)
                cells, counts = _unpacked(n, body, kind)
                held[cells] = np.minimum(held[cells] + counts, min_count)
        if at is not None:
            yield out()

    made = documents.mapInArrow(parts, "depth int, shard bigint, n int, body binary")
    return made.repartition("depth", "shard").sortWithinPartitions("depth", "shard").mapInArrow(merge, "depth int, shard bigint, bits binary")


def _bitmap(shards: list, bits: int, bitmap_bits: int) -> list[bytes]:
    """The rows' bitmaps, compressed, from the shards' bits."""
    fold = max(0, bits - bitmap_bits)
    shard_bits = _shard_bits(bits)
    each = max(1, 1 << max(0, shard_bits - fold))  # bits of a shard
    out = [np.zeros(max(1, (1 << (bits - fold)) // 8), dtype=np.uint8) for _ in range(DEPTH)]
    for s in shards:
        own = np.frombuffer(pa.decompress(s.bits, (each + 7) // 8, "zstd"), dtype=np.uint8)
        if each >= 8:
            out[s.depth][s.shard * each // 8 : (s.shard + 1) * each // 8] = own
        else:  # several shards in a byte
            place = (s.shard << shard_bits) >> fold
            for j in range(each):
                if own[0] >> (7 - j) & 1:
                    out[s.depth][(place + j) // 8] |= np.uint8(128 >> (place + j) % 8)
    return [pa.compress(row.tobytes(), "zstd", asbytes=True) for row in out]


def exact_counts(documents: DataFrame, *, max_words: int = 4, min_count: int = 30, width_bits: int | None = None, bitmap_bits: int = 27, block_bytes: int = 1 << 22) -> DataFrame:
    """(lang, words, phrase, f): the exact count of every n-gram of at least ``min_count``, and with words 0 and an empty phrase that of all words."""
    spark = documents.sparkSession
    texts = documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if width_bits is None:  # about one cell in each row of the sketch for every four words and pairs
        width_bits = max(20, int(size // 16).bit_length())
    how = (min_count, width_bits, bitmap_bits, block_bytes)
    # what is collected are the bitmaps, of bounded size
    pairs = Seen(spark, sketch(texts, range(1, 3), None, *how).collect(), width_bits, bitmap_bits)
    longer = Seen(spark, sketch(texts, range(3, max_words + 1), pairs, *how).collect(), width_bits, bitmap_bits) if max_words > 2 else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = _salts(batch.column("lang"))
            for first, last, data, offsets, limit in blocks(batch.column("text"), block_bytes, max_words):
                block = Block(data, offsets, limit)
                if not block.own:
                    continue
                langs = batch.column("lang").slice(first, last - first)
                entry, which = distinct_words(data, block.starts, block.ends - block.starts)
                coded = langs.dictionary_encode()
                lang_of = coded.indices.to_numpy(zero_copy_only=False)
                totals = np.bincount(lang_of[block.row[: block.own]], minlength=len(coded.dictionary))
                yield _rows(coded.dictionary, np.zeros(len(totals), np.int32), pa.array([""] * len(totals)), totals)
                spaced = np.append(data, np.uint8(0x20))
                starts, lens = block.starts[entry], (block.ends - block.starts)[entry]
                for n in range(1, max_words + 1):
                    if n == 3:
                        block.only_pairs(pairs, salts[first:last])
                    at, hashes = block.grams(n, salts[first:last])
                    ok = (pairs if n < 3 else longer).test(hashes)
                    at, hashes = at[ok], hashes[ok]
                    if not len(at):
                        continue
                    _, one, back, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                    same = lang_of[block.row[at]] == lang_of[block.row[at[one[back]]]]
                    for j in range(n):  # equal hashes are not yet equal phrases
                        same &= which[at + j] == which[at[one[back]] + j]
                    if not same.all():
                        counts = np.append(counts - np.bincount(back[~same], minlength=len(one)), np.ones((~same).sum(), np.int64))
                        one = np.append(one, np.flatnonzero(~same))
                    firsts = at[one]
                    part_starts = np.full((len(firsts), 2 * n - 1), len(data), dtype=np.int64)
                    part_lens = np.ones((len(firsts), 2 * n - 1), dtype=np.int64)
                    for j in range(n):
                        part_starts[:, 2 * j], part_lens[:, 2 * j] = starts[which[firsts + j]], lens[which[firsts + j]]
                    texts = gather(spaced, part_starts.ravel(), part_lens.ravel())
                    ends = np.concatenate(([0], np.cumsum(part_lens.sum(axis=1))))
                    phrases = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(ends), pa.py_buffer(texts)]).cast(pa.string())
                    yield _rows(coded.dictionary.take(pa.array(lang_of[block.row[firsts]])), np.full(len(firsts), n, np.int32), phrases, counts)

    tasks = max(2 * spark.sparkContext.defaultParallelism, int(size // TASK_BYTES))
    counted = texts.coalesce(tasks).mapInArrow(count, "lang string, words int, phrase string, f bigint")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= min_count))


def _rows(langs: pa.Array, n: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(n, pa.int32()), phrases, pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "f"])


def score(counts: DataFrame, *, cover_percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """Every candidate (2 words or more) that no longer one covers: lang, phrase, a, l, r, score of its lowest-scoring cut."""
    known = counts.where("words > 0").select("lang", "words", "phrase", "f")
    cand = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = cand.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = known.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    points = F.expr(f"(cast(a as decimal(20, 0)) * {scale}) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.select("lang", "phrase", "a", F.struct(points.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("cut").alias("cut"))
    # what longer candidates hold: the greatest count for each phrase inside them
    longer = cand.where("words > 2").select("lang", "w", "words", F.col("f").alias("outer_f"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    longer = longer.select("lang", "w", "m", "outer_f", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    covers = longer.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("outer_f").alias("outer_f"))
    kept = best.join(covers, ["lang", "phrase"], "left").where(f"outer_f is null or cast(outer_f as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {cover_percent}")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(documents: DataFrame, *, top: int = 2000, max_words: int = 4, min_count: int = 30, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` candidates by score, then count, then phrase."""
    counts, path = written(exact_counts(documents, max_words=max_words, min_count=min_count, **how), "ngrams")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = score(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    out = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    made, _ = written(out, "collocations")  # at most ``top`` rows for each language
    remove(documents.sparkSession, path)
    return made

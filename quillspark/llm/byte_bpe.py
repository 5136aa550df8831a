"""Byte-level BPE encoding and decoding by merge replay over the distinct words of many texts at once.

A task takes its documents in blocks of about ``block_bytes`` of text. In each block:

1. The split pattern is applied to all texts at once, as rules on runs of character classes (letters, numbers, white
   space, others), with numpy. The classes are read from the tokenizer library once for each worker, so its Unicode version holds.
2. Equal words become one entry (hashes sorted, then every occurrence compared byte by byte with its entry).
3. The merges are replayed over all entries together. An inverted index holds, for each rank, the positions of the token
   pairs that make it; the least rank is taken off a heap, all its pairs are merged from left to right, and only the pairs
   with the touched neighbours get new index entries.
   Words are independent of one another, so this is what the library does word by word. Where a merge would make a pair
   of a *lower* rank, the word's further merges of the rank wait until that one is done.
4. Ids are joined back to the texts by position; decoding gathers the bytes of the ids.

A table of all words of the corpus would have to be joined back by word occurrence, which shuffles several times the input;
blocks need no shuffle, and a lost executor costs its blocks only.

Defined results: a null text counts as empty, and an empty text has no ids; rows keep their doc_id (null and repeated
ones too, each row is encoded by itself); columns besides doc_id and text are ignored. A text longer than ``CUT`` is cut
for the numpy work only, where white space follows an ASCII character that is none: no word crosses such a place. One word
of any length is encoded whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._text import SLICE_BYTES, distinct_words, gather, slices

LETTER, NUMBER, SPACE, OTHER = range(4)
CUT = 1 << 20
NONE = np.int32(2**31 - 1)

_coders: dict[tuple[str, str], ByteCoder] = {}


def character_classes(letter: str = r"\p{L}", number: str = r"\p{N}", space: str = r"\s") -> np.ndarray:
    """The class of every code point, as the tokenizer library sees it."""
    import tiktoken

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, letter), (NUMBER, number), (SPACE, space)):
        found = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=plain, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteCoder:
    """Ranks of byte strings, with what the replay looks up in them."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.longest = max(map(len, ranks))
        made = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    made[a << 32 | b] = rank
        self.pairs = np.array(sorted(made), dtype=np.int64)
        self.pair_ranks = np.array([made[k] for k in self.pairs.tolist()], dtype=np.int32)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        by_rank = dict(zip(ranks.values(), ranks, strict=True))
        tokens = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_lens = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two neighbouring tokens; NONE where they do not merge (a separator is -1)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def word_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words begin: matches of the split pattern in each row. Every byte belongs to a word."""
        if not len(data):
            return np.zeros(0, dtype=np.int64)
        at, point = _code_points(data)
        kind = self.classes[point]
        n = len(at)
        first = np.zeros(n + 1, dtype=bool)  # characters that begin a row, and the end
        first[np.searchsorted(at, offsets)] = True
        first = first[:n]
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[0], before[1:] = 255, kind[:-1]
        after[-1], after[:-1] = 255, kind[1:]
        before[first] = 255
        after[np.append(first[1:], True)] = 255
        blank = np.append(False, point[:-1] == 0x20) & ~first  # a blank before a run of anything else joins it
        starts = (kind != before) & ~(blank & (kind != SPACE))
        starts |= (kind == SPACE) & (before == SPACE) & (after != SPACE) & (after != 255)  # the last of several, before something else
        quote = np.flatnonzero((point == 0x27) & starts & (after == LETTER))
        if len(quote):
            one = _at(point, quote + 1)
            # fixed values: the endings that the pattern splits off behind an apostrophe
            short = np.isin(one, [ord(c) for c in "stmd"])
            same = (quote + 2 < n) & ~_at(first, quote + 2)
            long = np.isin(one.astype(np.int64) << 32 | _at(point, quote + 2), [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & same
            ends = quote + 1 + np.where(short, 1, 2)
            found = short | long
            starts[quote[found] + 1] = False
            ends = ends[found]
            starts[ends[ends < n]] = True
        return at[starts]

    def replay(self, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after another, and how many each has. ``words`` are their bytes, one after another."""
        n, size = len(lens), len(words) + len(lens)
        begin = np.cumsum(lens + 1) - (lens + 1)
        tok = np.full(size + 1, -1, dtype=np.int32)
        inside = np.ones(size, dtype=bool)
        inside[begin + lens] = False
        tok[:size][inside] = self.of_byte[words]
        nxt = np.arange(1, size + 2, dtype=np.int32)
        prv = np.arange(-1, size, dtype=np.int32)
        rank = np.full(size + 1, NONE, dtype=np.int32)
        for low in range(0, size, 1 << 20):
            high = min(low + (1 << 20), size)
            rank[low:high] = self.pair_rank(tok[low:high], tok[low + 1 : high + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            """Put positions under their ranks."""
            some = ranks != NONE
            places, ranks = places[some], ranks[some]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for i, r in enumerate(ranks[edges[:-1]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[edges[i] : edges[i + 1]])

        live = np.flatnonzero(rank != NONE).astype(np.int32)
        add(live, rank[live])
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = p[rank[p] == r]  # those that are still there
            if len(p) > 1:
                p = np.sort(p)
                p = p[np.append(True, p[1:] != p[:-1])]
            if not len(p):
                continue
            every, q = p, nxt[p]
            if len(p) > 1 and (over := p[1:] == q[:-1]).any():  # pairs that overlap: every other one of a chain, from the left
                chain = np.append(False, over)
                heads = np.maximum.accumulate(np.where(chain, 0, np.arange(len(p))))
                take = (np.arange(len(p)) - heads) % 2 == 0
                p, q = p[take], q[take]
            right, left = nxt[q], prv[p]
            joined = np.append(False, right[:-1] == p[1:]) if len(p) > 1 else np.zeros(1, dtype=bool)  # directly behind another merge
            of_left, of_right = self.pair_rank(np.where(joined, r, tok[left]), np.full(len(p), r)), self.pair_rank(np.full(len(p), r), tok[right])
            lower = (of_left < r) | (of_right < r)
            if lower.any():
                owner = np.searchsorted(begin, p, side="right")
                last = np.full(n + 1, len(p))
                np.minimum.at(last, owner[lower], np.flatnonzero(lower))
                now = np.arange(len(p)) <= last[owner]
                if not now.all():  # the word's further merges wait for the lower rank
                    index[r] = [every]
                    heapq.heappush(heap, r)
                    p, q, right, left, joined, of_left, of_right = (x[now] for x in (p, q, right, left, joined, of_left, of_right))
            if joined.any():
                left[joined] = p[:-1][joined[1:]]
                of_right[:-1][joined[1:]] = self.pair_rank(np.array([r]), np.array([r]))[0]
            tok[p], tok[q], rank[q] = r, -1, NONE
            nxt[p], prv[right] = right, p
            rank[p], rank[left] = of_right, of_left
            add(np.concatenate((p, left)), np.concatenate((of_right, of_left)))
        kept = tok[:size] >= 0
        counts = np.add.reduceat(kept.astype(np.int64), begin) if n else np.zeros(0, np.int64)
        return tok[:size][kept], counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and how many each row has."""
        starts = list(self._all_starts(data, offsets))
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        lens = np.diff(np.append(starts, len(data)))
        entry, which = distinct_words(data, starts, lens)
        words = [bytes(data[s : s + k]) if k <= self.longest else b"" for s, k in zip(starts[entry].tolist(), lens[entry].tolist(), strict=True)]
        whole = np.array([self.ranks.get(w, -1) for w in words], dtype=np.int32)  # a word that is a token takes its id as it is
        rest = np.flatnonzero(whole < 0)
        ids, counts = self.replay(gather(data, starts[entry[rest]], lens[entry[rest]]), lens[entry[rest]])
        count = np.ones(len(entry), dtype=np.int64)
        count[rest] = counts
        place = np.empty(len(entry), dtype=np.int64)
        place[rest] = np.cumsum(counts) - counts
        place[whole >= 0] = len(ids) + np.arange(len(entry) - len(rest))
        ids = np.concatenate((ids, whole[whole >= 0]))
        out = gather(ids, place[which], count[which])
        row = np.searchsorted(offsets, starts, side="right") - 1
        return out, np.bincount(row, weights=count[which], minlength=len(offsets) - 1).astype(np.int64)

    def _all_starts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Word starts, worked out for about half a megabyte of rows or pieces of long rows at a time."""
        edges = [offsets]
        for i in np.flatnonzero(np.diff(offsets) > CUT).tolist():
            edges.append(_safe_cuts(data, int(offsets[i]), int(offsets[i + 1])))
        pieces = np.unique(np.concatenate(edges))
        low = 0
        while low < len(pieces) - 1:
            high = max(low + 1, int(np.searchsorted(pieces, pieces[low] + SLICE_BYTES, side="right")) - 1)
            yield self.word_starts(data[pieces[low] : pieces[high]], pieces[low : high + 1] - pieces[low]) + pieces[low]
            low = high

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.token_bytes, self.token_starts[ids], self.token_lens[ids])


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at places; beyond the end the last one, for callers that test the place too."""
    return values[np.minimum(places, len(values) - 1)]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each UTF-8 character begins, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.int32)
    for more, low, mask in ((1, 0xC0, 0x1F), (2, 0xE0, 0x0F), (3, 0xF0, 0x07)):
        wide = np.flatnonzero((point >= low) & (point < {1: 0xE0, 2: 0xF0, 3: 0x100}[more]) & (at + more < len(data)))
        if len(wide):
            value = data[at[wide]].astype(np.int32) & mask
            for j in range(1, more + 1):
                value = value << 6 | (data[at[wide] + j].astype(np.int32) & 0x3F)
            point[wide] = value + 0x10000000  # not to be taken for a lead byte of a longer form
    point[point >= 0x10000000] -= 0x10000000
    return at, np.minimum(point, 0x10FFFF)


def _safe_cuts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in a long row that no word crosses, about ``SLICE_BYTES`` apart: white space behind an ASCII character that is none."""
    own = data[low:high]
    white = (own == 0x20) | ((own >= 0x09) & (own <= 0x0D))
    ok = np.flatnonzero(white[1:] & ~white[:-1] & (own[:-1] < 0x80) & ((own[:-1] < 0x1C) | (own[:-1] > 0x20))) + 1
    if not len(ok):
        return ok
    return low + ok[np.unique(np.minimum(np.searchsorted(ok, np.arange(SLICE_BYTES, high - low, SLICE_BYTES)), len(ok) - 1))]


def coder(rank_file: str) -> ByteCoder:
    if rank_file not in _coders:
        _coders[rank_file] = ByteCoder(read_ranks(rank_file), character_classes())
    return _coders[rank_file]


def encode(documents: DataFrame, rank_file: str, *, block_bytes: int = 1 << 24) -> DataFrame:
    """One row for each document: doc_id, ids (array<int>) of its whole text without special tokens, decoded (binary, the bytes of these ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text"), block_bytes):
                ids, counts = own.encode(data, offsets)
                ends = np.concatenate(([0], np.cumsum(counts)))
                lens = own.token_lens[ids]
                sizes = np.concatenate(([0], np.cumsum(lens)))[ends]
                low = 0
                while low < last - first:  # rows of about a megabyte at a time
                    high = min(last - first, max(low + 1, int(np.searchsorted(sizes, sizes[low] + (1 << 20), side="right")) - 1))
                    part = ids[ends[low] : ends[high]]
                    lists = pa.LargeListArray.from_arrays(pa.array(ends[low : high + 1] - ends[low], pa.int64()), pa.array(part, pa.int32())).cast(pa.list_(pa.int32()))
                    cut = (sizes[low : high + 1] - sizes[low]).astype(np.int32)
                    decoded = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(own.decode(part)))])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first + low, high - low), lists, decoded], names=["doc_id", "ids", "decoded"])
                    low = high

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

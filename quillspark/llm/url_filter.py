"""URL filtering against a sorted digest array.

The list of rules (host, path, verdict) becomes 64-bit xxhash keys of
``host + path`` in ascending order with the full strings behind them, cut by key range
into shards of about ``shard_bytes``. Tasks build the shards in the shared folder; every executor fetches each once
and maps it into memory, so a list is bounded by an executor's disk only. URLs are probed with a
vectorised binary search, and each match is confirmed on the stored full string,
so a digest collision cannot judge a URL.

A rule fits its host and every subdomain of it, where the URL's path starts with
the rule's path. For each URL the candidates are each suffix of its host at a label
boundary with no more labels than the longest rule, joined with its path cut to each path length that occurs in the rules;
the longest rule that is confirmed wins, of equally long ones the one of the longer host. URLs that no rule fits have the verdict
``default``.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
the end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A null
URL, or one without ``://``, has neither and fits no rule. Rules that repeat
(host, path) must agree, else an error is raised; empty rules fit nothing; columns
besides the named ones are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import written

_open: dict[str, dict[int, DigestArray]] = {}


class DigestArray:
    """Keys, string offsets, strings and verdicts of one file, mapped into memory."""

    def __init__(self, path: str):
        head = np.memmap(path, dtype=np.int64, mode="r", shape=(2,))
        n, m = int(head[0]), int(head[1])
        at = 24 + 8 * m  # the most labels of a host and the path lengths stand in front
        self.labels, *self.lengths = np.memmap(path, dtype=np.int64, mode="r", offset=16, shape=(m + 1,)).tolist()
        self.keys = np.memmap(path, dtype=np.uint64, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, dtype=np.int64, mode="r", offset=at + 8 * n, shape=(n + 1,))
        size = int(self.ends[-1])
        self.text = np.memmap(path, dtype=np.uint8, mode="r", offset=at + 8 * (2 * n + 1), shape=(size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def packed(rules: list[tuple[str, str, str]]) -> bytes:
        """The contents of a file."""
        entries: dict[str, str] = {}
        for host, prefix, verdict in rules:
            if host and entries.setdefault(host + prefix, verdict) != verdict:
                raise ValueError(f"rules disagree on {host}{prefix}")
        held = sorted((xxhash.xxh64_intdigest(k.encode()), k, v) for k, v in entries.items())
        lengths = np.array(sorted({len(p.encode()) for h, p, _ in rules if h}), dtype=np.int64)
        strings = [f"{v}\0{k}".encode() for _, k, v in held]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
        labels = max((h.count(".") + 1 for h, _, _ in rules if h), default=0)
        head = np.array([len(held), len(lengths), labels], dtype=np.int64).tobytes() + lengths.tobytes()
        return head + np.array([h for h, _, _ in held], dtype=np.uint64).tobytes() + ends.tobytes() + b"".join(strings)

    @staticmethod
    def build(path: str, rules: list[tuple[str, str, str]]) -> None:
        with open(path, "wb") as f:
            f.write(DigestArray.packed(rules))

    def find(self, probes: list[bytes], want: np.ndarray | None = None) -> list[str | None]:
        """The verdict stored for each full string, or None; ``want`` has the digests if they are known."""
        if not probes or not len(self.keys):
            return [None] * len(probes)
        want = digests(probes) if want is None else want
        at = np.searchsorted(self.keys, want)
        out: list[str | None] = [None] * len(probes)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == want[i]:  # digests may collide: the string decides
                verdict, _, full = self.text[self.ends[j] : self.ends[j + 1]].tobytes().partition(b"\0")
                if full == probes[i]:
                    out[i] = verdict.decode()
                    break
                j += 1
        return out


def digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), dtype=np.uint64, count=len(strings))


def _range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each key: its first ``bits`` bits."""
    return (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def build_shards(entries: DataFrame, bits: int) -> list[str]:
    """Sorted digest arrays of ``entries`` (host, path, verdict), one for each key range, built by tasks; the names under which executors fetch them."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [(h + p).encode() for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_range_of(digests(full), bits))], names=["host", "path", "verdict", "shard"])

    def build(part: pa.Table) -> pa.Table:
        data = DigestArray.packed(list(zip(*(part.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True)))
        return pa.table({"shard": part.column("shard").slice(0, 1), "data": pa.array([data], pa.binary())})

    placed = entries.mapInArrow(place, "host string, path string, verdict string, shard long")
    shards, _ = written(placed.groupBy("shard").applyInArrow(build, "shard long, data binary"), "digests")
    files = shards.inputFiles()  # names only; they stay in the shared folder for executors that come later
    for file in files:
        entries.sparkSession.sparkContext.addFile(file)
    return [os.path.basename(file) for file in files]


def _mapped(names: list[str]) -> dict[int, DigestArray]:
    """The shards by number, mapped into memory; the first worker of an executor unpacks a fetched file beside it."""
    shards: dict[int, DigestArray] = {}
    for name in names:
        if name not in _open:
            fetched, _open[name] = SparkFiles.get(name), {}
            for batch in pq.ParquetFile(fetched).iter_batches(batch_size=1):
                shard, path = batch.column("shard")[0].as_py(), f"{fetched}.{batch.column('shard')[0]}"
                if not os.path.exists(path):
                    own = f"{path}.{os.getpid()}"
                    with open(own, "wb") as f:
                        f.write(batch.column("data")[0].as_buffer())
                    os.replace(own, path)
                _open[name][shard] = DigestArray(path)
        shards |= _open[name]
    return shards


def _find(shards: dict[int, DigestArray], bits: int, probes: list[bytes]) -> list[str | None]:
    """The verdict stored for each full string in the shard of its digest, or None."""
    want, out = digests(probes), [None] * len(probes)
    places = _range_of(want, bits)
    for shard in np.unique(places).tolist():
        own = np.flatnonzero(places == shard)
        if shard in shards:
            for i, verdict in zip(own.tolist(), shards[shard].find([probes[i] for i in own], want[own]), strict=True):
                out[i] = verdict
    return out


def candidates(host: str, path: str, most_labels: int, lengths: list[int]) -> list[bytes]:
    """All full strings of rules that would fit: suffixes of the host of ``most_labels`` at most, with each length of path."""
    labels = host.rsplit(".", most_labels)[-most_labels:]
    hosts = [".".join(labels[i:]).encode() for i in range(len(labels))]
    raw = path[: max(lengths, default=0)].encode()
    return [h + raw[:n] for h in hosts for n in lengths if n <= len(raw)]


def filter_urls(urls: DataFrame, rules: DataFrame, *, url: str = "url", key: str = "page_id", default: str = "allow", shard_bytes: int = 32 << 20) -> DataFrame:
    """(key, host, path, rule, verdict) for each URL; ``rules`` has host, path and verdict."""
    entries = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").distinct()
    full, length = F.concat("host", "path"), F.octet_length("path")
    of_each = entries.groupBy(full.alias("full")).agg((F.min("verdict") != F.max("verdict")).alias("differ"), F.max(F.regexp_count("host", F.lit("[.]")) + 1).alias("labels"), F.collect_set(length).alias("lengths"))
    known = of_each.agg(
        F.max(F.when(F.col("differ"), F.col("full"))).alias("disputed"), F.coalesce(F.max("labels"), F.lit(0)).alias("labels"),
        F.coalesce(F.sum(F.octet_length("full") + 32), F.lit(0)).alias("bytes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lengths")))).alias("lengths"),
    ).first()
    if known["disputed"] is not None:
        raise ValueError(f"rules disagree on {known['disputed']}")
    labels, lengths, bits = known["labels"], known["lengths"], 0
    while known["bytes"] > shard_bytes << bits:
        bits += 1
    names = build_shards(entries, bits)

    rest = F.substring(F.col(url), F.locate("://", F.col(url)) + 3, F.length(url))
    raw = F.when(F.contains(F.col(url), F.lit("://")), rest).otherwise("")
    raw = F.coalesce(raw, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # (?s): a dot also stands for a line break in a URL
    parts = urls.select(key, F.translate(F.regexp_extract(raw, r"^[^/?#]*", 0), upper, lower).alias("host"), F.regexp_extract(raw, r"^[^/?#]*([^?#]*)", 1).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _mapped(names)
        for batch in batches:
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for c in candidates(h, p, labels, lengths) if h and labels else []:
                    probes.append(c)
                    owner.append(i)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            best = [-1] * batch.num_rows
            for i, c, v in zip(owner, probes, _find(shards, bits, probes), strict=True):
                if v is not None and len(c) > best[i]:
                    rule[i], verdict[i], best[i] = c.decode(), v, len(c)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in (key, "host", "path")}, "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    kind = dict(urls.dtypes)[key]
    return parts.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")

"""SentencePiece encoding and decoding through a table of distinct chunks.

The vocabulary is checked once for each worker: no piece has a white-space
marker after another character. A merge can then never reach over the start of a
marked word, so a text is the sequence of its chunks (a run of markers and the
characters up to the next marker), each of which is segmented by itself. Every
distinct chunk is segmented once in a table that a worker keeps between
batches (``table_rows`` bounds its memory: beyond it the table starts anew, which
changes no result), and ids are joined back by position. A vocabulary that
fails the check is encoded text by text.

Encoding adds no begin or end ids and samples nothing. Decoding is the
library's own ``decode(ids)``.

Defined results: a null text counts as empty, and an empty text has no ids;
rows keep their doc_id, repeated rows are encoded again; columns besides the
named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Longer chunks are segmented each time: keeping them would let few texts fill the table.
KEEP_CHARS = 64

_coders: dict[tuple[str, int], Coder] = {}


class Coder:
    """A SentencePiece model with its table of distinct chunks."""

    def __init__(self, model_file: str, table_rows: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table_rows = table_rows
        self.alone = {"": [self.model.piece_to_id(MARK)]}
        self.table = dict(self.alone)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # the checks that a text is its chunks: no piece crosses a marker, white space is kept, and one marker is put first
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.id_to_piece(self.alone[""][0]) == MARK and self._plain("a b  c ")

    def _plain(self, text: str) -> bool:
        """Whether the normaliser keeps white space and puts one marker first."""
        whole = "".join(self.model.id_to_piece(i) for i in self.model.encode(text))
        return whole == MARK + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.apart:
            return self.model.encode(texts, num_threads=1)
        split = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        split = [_chunks(parts) if "" in parts else parts for parts in split]
        if len(self.table) > self.table_rows:
            self.table = dict(self.alone)
        table = self.table
        new = list({c for parts in split for c in parts if c not in table})
        ids = self.model.encode(new, num_threads=1)
        for chunk, found in zip(new, ids, strict=True):
            table[chunk] = found
        out = []
        for parts in split:
            row: list[int] = []
            for c in parts:
                row += table[c]
            out.append(row)
        for chunk in new:
            if len(chunk) > KEEP_CHARS:
                del table[chunk]
        return out


def _chunks(parts: list[str]) -> list[str]:
    """Join the empty parts that a run of blanks leaves to the word behind them; each chunk lacks its last marker, which the model puts first."""
    out, blanks = [], 0
    for p in parts:
        if p:
            out.append(" " * blanks + p)
            blanks = 0
        else:
            blanks += 1
    if blanks:
        out.append(" " * (blanks - 1))  # of one blank: the empty chunk, the marker by itself
    return out


def coder(model_file: str, table_rows: int) -> Coder:
    key = (model_file, table_rows)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def encode(documents: DataFrame, model_file: str, *, table_rows: int = 150_000, keep_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, ids (array<int>) of its whole text, decoded (what the library makes of these ids), and its text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_file, table_rows)
        for batch in batches:
            texts = batch.column("text")
            for first, rows in _parts(texts):
                got = own.encode([t or "" for t in rows])
                made = {"doc_id": batch.column("doc_id").slice(first, len(rows)), "ids": pa.array(got, pa.list_(pa.int32())), "decoded": pa.array(own.model.decode(got, num_threads=1), pa.string())}
                if keep_text:
                    made["text"] = texts.slice(first, len(rows))
                yield pa.RecordBatch.from_pydict(made)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string" + ", text string" * keep_text)


def _parts(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of about ``size`` characters, so that ids in Python stay few at any time."""
    rows, first, held = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        rows.append(t)
        held += len(t or "")
        if held >= size:
            yield first, rows
            rows, first, held = [], i + 1, 0
    if rows:
        yield first, rows


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

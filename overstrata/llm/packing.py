"""Best-fit packing of token pieces into sequences.

Documents become token ids and an end id; only those longer than a sequence are cut, with the short piece first.
Full pieces are sequences of their own. The others go through a bounded-space online best-fit: a fixed number of
bins is open, a bitset keyed by free space says at once which free space fits best, and when a bin must be opened
beyond the number, the fullest closes first.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 4096
#: Pieces that one task packs; a partition's open bins are its only loss, so more pieces a task fill better.
PIECES_PER_TASK = 400_000


class Packer:
    """Bounded-space online best-fit. ``put`` gives (bin, offset in it)."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f: some open bin has f free
        self.n_open = 0
        self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            bins = self.by_free[free]
            b = bins.pop()
            if not bins:
                self.bits &= ~(1 << free)
            self.n_open -= 1
        else:
            if self.n_open >= self.open_bins:
                self._close()
            free, b = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:  # a full bin is closed
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
        return b, self.capacity - free

    def _close(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1


class _Ids(dict):
    """Little-endian ids of a word, by the word with the blank before it. Cleared when it grows beyond its bound."""

    LIMIT, LONGEST = 250_000, 48

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self.encode(" " + word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = out
        return out


class Tokens:
    """Token ids as little-endian unsigned 32-bit bytes.

    The pattern of the byte-level vocabulary never joins a word with what stands before its blank, so texts are cut
    before blanks and words are looked up. A run of white space is one of its pieces, without the last character before a
    word; texts with a blank inside such a piece, or with a special token's string, are encoded whole.
    """

    #: A blank after white space that no word follows at once. Every white space of the vocabularies is one of Python's.
    UNSAFE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, vocabulary: str, ranks: str):
        import array
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.whole = lambda text: array.array("I", own.encode(text, add_special_tokens=False).ids).tobytes()
        self.words = _Ids(lambda text: array.array("I", fast.encode_ordinary(text)).tobytes())
        self.part = self.words.encode
        self.special = [t.content for t in own.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or self.UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.part(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))


_tokens: dict[tuple, Tokens] = {}


def tokenizer(vocabulary: str | None = None, ranks: str | None = None) -> Tokens:
    """One for each Python worker. The default paths are those of the public byte-level vocabulary."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    if (vocabulary, ranks) not in _tokens:
        _tokens[vocabulary, ranks] = Tokens(vocabulary, ranks)
    return _tokens[vocabulary, ranks]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; the ids themselves stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(vocabulary, ranks), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                a, b = 0, n % sequence or min(sequence, n)
                piece = 0
                while a < n:
                    for x, v in zip(out, (doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        x.append(v)
                    a, b, piece = b, b + sequence, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, PIECES, strict=True)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, open_bins: int = OPEN_BINS, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. Only pieces that don't fill a sequence are shuffled, as numbers."""
    C.bounded_batches(docs)
    cut = C.Table(pieces(docs, sequence, end_id, vocabulary, ranks), "pieces").df
    partial, full = cut.filter(F.col("length") < sequence), cut.filter(F.col("length") >= sequence)
    tasks = max(1, -(-partial.count() // PIECES_PER_TASK))
    names = [*PIECES.names, "sequence_id", "offset"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(sequence, open_bins), (2 * TaskContext.get().partitionId()) << 40
        for batch in batches:
            where = [packer.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64())], names=names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, base = 0, (2 * TaskContext.get().partitionId() + 1) << 40
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(base + n, base + n + k), pa.int64()), pa.array([0] * k, pa.int64())], names=names)
            n += k

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # A hash order mixes lengths, and makes a repeated task pack the same way.
    mixed = partial.repartition(tasks, F.xxhash64("doc_id", "start", "length", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id", "piece"), *PIECES.names)
    return mixed.mapInArrow(number, schema).union(full.mapInArrow(alone, schema))

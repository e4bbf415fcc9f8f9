"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that can end a valid encoding of it: the
one whose junction with the prefix before it survives merging. Storing that token for every prefix
gives the encoding by walking back from the end, exact appends (only new positions are computed) and
re-encoding near edits (positions are recomputed until they agree with the old ones again).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.common import small_batches, table

#: Entries of the per-worker caches; beyond it the older half is forgotten.
CACHE_PIECES, CACHE_PAIRS, CACHE_CHARS = 300_000, 300_000, 64
#: Stands before the first token.
_START = 1 << 30


class _Cache(dict):
    """``compute(key)`` for missing keys, holding two generations of at most ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Tokens of a rank file: ``base64 rank`` on each line."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self.joins = _Cache(self._joined, CACHE_PAIRS)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _joined(self, pair: int) -> int:
        """1 if the two tokens (before << 32 | token) stay as they are when their bytes are merged as one."""
        before, token = pair >> 32, pair & 0xFFFFFFFF
        if before == _START:
            return int(self.merged(self.bytes[token]) == [token])
        return int(self.merged(self.bytes[before] + self.bytes[token]) == [before, token])

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


class Prefixes:
    """The unique valid last token of every prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = [_START]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Only the new prefixes are computed; those before stay valid."""
        at = len(self.data)
        self.data += data
        self.last += [-1] * len(data)
        self._fill(at, len(self.data))

    def _fill(self, start: int, stop: int) -> None:
        """The last tokens of the prefixes that end in (start, stop], longest candidates first."""
        last, joins = self.last, self.vocabulary.joins
        low = max(0, start - self.vocabulary.longest)
        for end, (size, token) in self.vocabulary.ends.iter(self.data[low:stop].decode("latin-1")):
            end += low + 1
            if end > start and last[end] < 0:
                before = last[end - size]
                if before >= 0 and joins[before << 32 | token]:
                    last[end] = token

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` for bytes [start, stop); returns how many prefixes were computed anew.

        The last token of a prefix follows from the last tokens of the ``longest`` prefixes before it,
        so once that many agree with the old ones, all after them do.
        """
        old, tail, shift = self.last, len(self.data) - stop, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        n, longest = len(self.data), self.vocabulary.longest
        self.last = old[: start + 1] + [-1] * (n - start)
        at = start
        first_kept = start + len(data)
        while at < n:
            upto = min(n, max(at + longest, first_kept))
            self._fill(at, upto)
            at = upto
            window = range(max(at - longest + 1, 0), at + 1)
            if at < n and window[0] > first_kept and all(self.last[i] == old[i - shift] for i in window):
                self.last[at + 1 :] = old[at + 1 - shift :]
                break
        assert len(self.last) == n + 1 and tail >= 0
        return at - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Codec:
    """Encodes texts piece by piece, as ``pattern`` splits them, without special tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.pieces = _Cache(self._piece, CACHE_PIECES)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return (whole,) if whole is not None else tuple(Prefixes(self.vocabulary, data).ids())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.find(text)
        if len(text) > 1000 and max(map(len, pieces), default=0) > CACHE_CHARS:  # long pieces aren't kept
            return list(chain.from_iterable(self.pieces[p] if len(p) <= CACHE_CHARS else self._piece(p) for p in pieces))
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker and vocabulary file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(Vocabulary.read(path), pattern)
    return _codecs[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` and a column ``ids`` array<int>. A null text counts as empty: no ids. Replaces a column ``ids``."""
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)
    path, pattern = _defaults(path, pattern)
    out = docs.withColumn("ids", F.lit(None).cast("array<int>"))

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(text).to_pylist()]
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, "ids", pa.array(ids, batch.schema.field(at).type))

    return out.mapInArrow(run, out.schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` and a column ``decoded`` binary from ``ids``. Null ids decode to no bytes."""
    from pyspark.sql import functions as F

    small_batches(rows.sparkSession)
    path, pattern = _defaults(path, None)
    out = rows.withColumn("decoded", F.lit(None).cast("binary"))

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("decoded")
            yield batch.set_column(at, "decoded", pa.array([own.decode(x or []) for x in batch.column("ids").to_pylist()], batch.schema.field(at).type))

    return out.mapInArrow(run, out.schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encodes, then decodes the ids, in one pass; with
    ``with_ids`` also ids array<int>.

    A null text counts as empty (no tokens; the hashes of nothing); one of any length is encoded whole. Repeated rows and
    null doc_ids stay as they are; an empty table gives none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    path, pattern = _defaults(path, pattern)

    def run(batches):
        own = codec(path, pattern)
        names = own.vocabulary.names.__getitem__
        for batch in batches:
            counts, hashes, decoded, kept = [], [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py())
                if with_ids:
                    kept.append(list(ids))
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            more = [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))

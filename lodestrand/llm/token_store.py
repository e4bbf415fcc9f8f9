"""Token ids in binary shards: each document compressed alone with one shared zstandard dictionary.

A shard is bytes: ``MAGIC``, the SHA-256 of the dictionary, the count of documents, an index of (end offset of the frame,
ids so far) for each, then the frames. Ids are little-endian, 2 bytes wide if the vocabulary has at most 65,536 ids, else
4. One document is read with the index and one frame. Shards lie in a table (one row each), since Spark's writers reach
every file system; the dictionary lies once beside it, and a shard that names another one is refused.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import shared_dir, small_batches, table

MAGIC = b"LTOK1\n"
#: The dictionary is trained on about so many documents (twice as many at most), chosen by a hash of doc_id, on so many
#: characters from anywhere in each, of these so many ids, to at most so many bytes.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_IDS, DICTIONARY_BYTES = 1_000, 8_192, 2_048, 65_536
#: A shard is closed beyond so many bytes of frames.
SHARD_BYTES = 1 << 20
#: Words that one Python worker remembers, and their ids in all; new words that are encoded together.
CACHE_WORDS, CACHE_IDS, GROUP = 360_000, 3_000_000, 256
#: Of these, so many that most batches had are kept when the others are forgotten.
CACHE_KEPT = 120_000
#: Letters that stay letters when lower-cased and composed (U+0130, say, becomes a letter and a mark), and marks that no
#: pretoken holds together with a letter before them.
_LETTER_THEN_MARK = r"([a-zÀ-ÖØ-öø-ÿ])([.,;:!?|])"
_HEAD = struct.Struct("<32sBI")


class WordEncoder:
    """A tokenizer whose white space only separates: words between ASCII blanks are encoded alone and remembered.

    Each word that a batch repeats is looked up once; what the batch's words encode to is gathered in one step. Texts that
    hold one of the tokenizer's added tokens, in any case of letters, are encoded whole. ``width``: bytes of an id.
    """

    #: Separates words that are encoded together: a control character, which is one token and part of no other.
    _MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.mark = self.tokenizer.encode(self._MARK, add_special_tokens=False).ids
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.added = "(?i)" + "|".join("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 20, self.kind)
        self.used = 0
        self.begin, self.size, self.seen = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _forget_rare(self) -> None:
        words, ids, begin, size, seen = list(self.known), self.ids, self.begin, self.size, self.seen[: len(self.known)]
        best = np.sort(np.argsort(-seen, kind="stable")[:CACHE_KEPT])
        best = best[size[best] <= 64]
        at = np.arange(int(size[best].sum())) + np.repeat(begin[best] - (np.cumsum(size[best]) - size[best]), size[best])
        self._forget()
        self._keep([words[k] for k in best.tolist()], ids[at], np.cumsum(size[best]) - size[best], size[best])

    def _keep(self, words: list[str], ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        while k + n > len(self.begin):
            self.begin, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.seen))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[k : k + n], self.size[k : k + n] = begins + self.used, sizes
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + n), strict=True))

    def _learn(self, words: list[str]) -> None:
        alone = words if len(self.mark) != 1 else [w for w in words if len(w) > 200 or self._MARK in w]
        if alone:
            apart = set(alone)
            words = [w for w in words if w not in apart]
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        together = self.tokenizer.encode_batch_fast([f" {self._MARK} ".join([*g, ""]) for g in groups] + alone, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in together[: len(groups)])), self.kind)
        ends = np.flatnonzero(ids == self.mark[0]) if groups else np.zeros(0, np.int64)
        begins = np.concatenate(([0], ends[:-1] + 1)) if groups else ends
        self._keep(words, ids, begins, ends - begins)
        for word, e in zip(alone, together[len(groups) :], strict=True):
            self._keep([word], np.array(e.ids, self.kind), np.zeros(1, np.int64), np.array([len(e.ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and len(texts) + 1 offsets. A null text has none."""
        texts = texts.fill_null("")
        special = pc.match_substring_regex(texts, self.added) if self.added != "(?i)" else pa.array([False] * len(texts))
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False)) if len(texts) else []
        if not len(whole):
            return self._by_words(texts)
        flat, offsets = self._by_words(pc.if_else(special, "", texts))
        coded = self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
        pieces, sizes, at = [], np.diff(offsets), 0
        for k, e in zip(whole.tolist(), coded, strict=True):
            pieces += [flat[at : offsets[k]], np.array(e.ids, self.kind)]
            at, sizes[k] = offsets[k], len(e.ids)
        return np.concatenate([*pieces, flat[at:]]), np.concatenate(([0], np.cumsum(sizes)))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # the tokenizer lower-cases, and parts these letters from a mark after them: either way the ids are the same
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_THEN_MARK, r"\1 \2")
        words = pc.ascii_split_whitespace(plain)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > CACHE_WORDS or self.used > CACHE_IDS:
            self._forget_rare()
        slots = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(slots < 0)):
            new = [(k, distinct[k]) for k in new.tolist()]
            self._learn([w for _, w in new])
            for k, w in new:
                slots[k] = self.known[w]
        self.seen[slots] += 1
        slots = slots[coded.indices.to_numpy()]
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.begin[slots] - (ends - sizes), sizes)
        offsets = np.asarray(words.offsets)
        return self.ids[at], np.concatenate(([0], ends))[offsets - offsets[0]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class ShardWriter:
    def __init__(self, dictionary: bytes, width: int, level: int = 3):
        self.dictionary, self.width = dictionary, width
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True).compress
        self.reset()

    def reset(self) -> None:
        self.frames: list[bytes] = []
        self.index: list[tuple[int, int]] = []
        self.size = self.ids = 0

    def add(self, ids: bytes) -> None:
        frame = self.compress(ids)
        self.frames.append(frame)
        self.size += len(frame)
        self.ids += len(ids) // self.width
        self.index.append((self.size, self.ids))

    def close(self) -> bytes:
        head = _HEAD.pack(hashlib.sha256(self.dictionary).digest(), self.width, len(self.index))
        out = b"".join([MAGIC, head, np.array(self.index, "<u8").reshape(-1, 2).tobytes(), *self.frames])
        self.reset()
        return out


class ShardReader:
    """Reads single documents of a shard. A dictionary that isn't the shard's is refused."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        digest, self.width, self.count = _HEAD.unpack_from(data, at := len(MAGIC))
        at += _HEAD.size
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary doesn't match the shard's hash of it")
        self.index = np.frombuffer(data, "<u8", 2 * self.count, at).reshape(-1, 2)
        self.data, self.base = data, at + 16 * self.count
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, k: int) -> np.ndarray:
        start = int(self.index[k - 1, 0]) if k else 0
        raw = self.decompress(self.data[self.base + start : self.base + int(self.index[k, 0])])
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")

    def start(self, k: int) -> int:
        """Ids of the shard before document ``k``."""
        return int(self.index[k - 1, 1]) if k else 0


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample of serialized id arrays; none if there is too little to learn from."""
    own = encoder(path)
    some = docs.where("length(text) > 0")
    step = max(1, some.count() // SAMPLE_DOCS)
    some = some.where(F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(step)) == 0)
    start = 1 + F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1))
    texts = [r[0] for r in some.select(F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS))).limit(2 * SAMPLE_DOCS).collect()]
    flat, offsets = own.encode(pa.array(texts, pa.string()))
    samples = [x for x in (flat[a:b][:SAMPLE_IDS].tobytes() for a, b in pairwise(offsets.tolist())) if len(x) >= 8]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Store(NamedTuple):
    """Shards (part int, seq int, doc_ids array, shard binary, n_ids long, before long; part and seq are the order of
    documents, before: ids of the part's shards before this one) and the dictionary that they name."""

    shards: DataFrame
    dictionary: bytes


def write(docs: DataFrame, path: str, end_id: int, at: str | None = None) -> Store:
    """Encode every text, append ``end_id``, write shards in ascending doc_id order under ``at`` (else a new shared folder).

    A null text counts as empty (the end id alone). Null doc_ids come first; rows that share a doc_id keep the order of
    their texts. Other columns are not read. Texts are dealt by ranges of doc_id before they are encoded, so that nothing
    is encoded twice. A text of any length is encoded whole. An empty table gives no shards.
    """
    spark = docs.sparkSession
    small_batches(spark, 600)
    rows = docs.select("doc_id", "text")
    at = at or f"{shared_dir(spark)}/lodestrand-{uuid.uuid4().hex}/tokens"
    dictionary = train_dictionary(rows, path)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{at}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part int, seq int, doc_ids array<{id_kind}>, shard binary, n_ids long, before long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        writer, end = ShardWriter(shared.value, own.width), np.array([end_id], own.kind).tobytes()
        part, seq, ids, before = None, 0, [], 0

        def shard(kind):
            nonlocal seq, ids, before
            n = writer.ids
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([writer.close()], pa.binary()), pa.array([n], pa.int64()), pa.array([before], pa.int64())], names=["part", "seq", "doc_ids", "shard", "n_ids", "before"])
            seq, ids, before = seq + 1, [], before + n
            return row

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            flat, offsets = own.encode(batch.column("text"))
            for doc, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                writer.add(flat[low:high].tobytes() + end)
                ids.append(doc)
                if writer.size >= SHARD_BYTES:
                    yield shard(kind)
        if ids:
            yield shard(kind)

    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{at}/shards")
    return Store(spark.read.schema(schema).parquet(f"{at}/shards"), dictionary)


def open_store(spark: SparkSession, at: str) -> Store:
    """What ``write`` left under ``at``."""
    return Store(spark.read.parquet(f"{at}/shards"), bytes(spark.read.parquet(f"{at}/dictionary").first()["dictionary"]))


def ids_of(store: Store, doc_id) -> list[list[int]]:
    """The ids, with the end, of each document of this doc_id: one frame of its shard is decompressed for each."""
    found = store.shards.where(F.array_contains("doc_ids", F.lit(doc_id))).orderBy("part", "seq").select("doc_ids", "shard")
    out = []
    for r in found.toLocalIterator():
        shard = ShardReader(bytes(r["shard"]), store.dictionary)
        out += [shard.ids(k).tolist() for k, d in enumerate(r["doc_ids"]) if d == doc_id]
    return out


def read(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards.

    ``start`` counts the ids of all documents before: of the parts before (one number for each range of doc_ids, gathered
    by the driver), of the part's shards before, and by the shard's own index. Shards are decoded where they are read.
    """
    shards, spark = store.shards, store.shards.sparkSession
    shared = spark.sparkContext.broadcast(store.dictionary)
    parts, so_far = [], 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        parts.append((r["part"], so_far))
        so_far += r["n"]
    offsets = F.broadcast(spark.createDataFrame(parts, "part int, offset long"))
    id_kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for ids, blob, before in zip(batch.column("doc_ids"), batch.column("shard"), batch.column("before").to_pylist(), strict=True):
                shard = ShardReader(blob.as_py(), shared.value)
                docs = [shard.ids(k) for k in range(shard.count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array([before + shard.start(k) for k in range(shard.count)], pa.int64()),
                        pa.array([len(x) for x in docs], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(offsets, "part").select("doc_ids", "shard", (F.col("offset") + F.col("before")).alias("before"))
    return placed.mapInArrow(run, f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to shards and read back from them."""
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))

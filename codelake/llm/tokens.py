"""Token ids in training order, as binary blocks of fixed stride.

Every document becomes sequences of ``length`` 16-bit ids, an end mark after its last token, filled up with zeros. The
sequences have an index: documents stand by (hash bucket of id and text, id, text), whatever files or tasks they come from,
so that a rerun on another cluster gives the same order. A keyed Feistel network on the next power of four, walked until it
falls below the number of sequences, sends the index to a slot; it is a bijection, so every slot is filled once and can be
traced back. Slots are dealt to partitions by range; each sorts its own and writes blocks of ``block`` slots, one row each,
whose payload holds the sequences in slot order at a fixed stride: slot s lies in block s div ``block`` at byte
(s mod ``block``) * 2 * length. write_shards() keeps them as files, sequences_from() reads on from any slot.

Defined cases: null or empty text: one sequence with the end mark only. Long texts take as many sequences as they need.
Null ids are carried as null, and stand first in their bucket. Repeated rows are encoded each by itself; which of two equal
rows comes first makes no difference. An empty table gives an empty result; other columns are ignored. The driver holds one
number for each of the BUCKETS.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import WordEncoder, tokenizer_path
from .common import CACHE, id_and_text, materialize, mix

LENGTH, BLOCK, SHARD_BLOCKS = 256, 1024, 64
#: Hash buckets of documents, and partitions that slots are dealt to, at most.
BUCKETS, MOST_PARTS = 1 << 17, 20_000
END = "<|endoftext|>"
#: Bytes of text whose distinct words are looked up at once.
SLICE = 1 << 22
#: Letters with one lower case each and no composition: ASCII and the accented ones up to U+00FF.
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªºµ")


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & low
        for k in keys:
            if back:
                left, right = right ^ (mix(left + k) & low), left
            else:
                left, right = right, left ^ (mix(right + k) & low)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys, back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


class IdBytes:
    """Texts to their ids as 16-bit little-endian bytes: Arrow splits them and finds the distinct words and stems, each is looked up once for some texts, and Arrow puts the ids in the words' places.

    A word of LETTERS, with stops after them or without, has the ids of its lower-cased letters, then those of the stops;
    others are encoded as they are. Found ids are kept while the bounded caches hold them.
    """

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder
        self.stems, self.others = {}, {}

    def shown(self, piece: bytes) -> str:
        return piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.encoder.letters)

    def stem(self, piece: bytes) -> bytes:
        value = self.stems.get(piece)
        if value is None:
            if len(self.stems) >= CACHE:
                self.stems.clear()
            value = self.stems[piece] = packed([t.id for t in self.encoder.model.tokenize(self.shown(piece))])
        return value

    def other(self, word: bytes) -> bytes:
        value = self.others.get(word)
        if value is None:
            if len(self.others) >= CACHE // 4:
                self.others.clear()
            value = self.others[word] = packed(self.encoder.word(word)) if word else b""
        return value

    def stems_of(self, words: pa.Array) -> pa.Array:
        """Ids of equal stems, looked up once."""
        d = words.dictionary_encode()
        return pa.array(list(map(self.stem, plain(d.dictionary))), pa.large_binary()).take(d.indices)

    def of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null: none."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        d = lists.flatten().dictionary_encode()
        body = pc.ascii_rtrim(d.dictionary, ".,")
        alpha = pc.match_substring_regex(body, f"^[{LETTERS}]+$")
        words, rest = d.dictionary.filter(alpha), d.dictionary.filter(pc.invert(alpha))
        stops = self.stems_of(pc.utf8_ltrim(words, LETTERS))
        known = pc.binary_join_element_wise(self.stems_of(pc.utf8_lower(body.filter(alpha))), stops, pa.scalar(b"", pa.large_binary()))
        values = pa.concat_arrays([known, pa.array(list(map(self.other, plain(rest))), pa.large_binary())])
        mask = alpha.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1, len(words) + np.cumsum(~mask) - 1)
        ids = values.take(pa.array(place[d.indices.to_numpy()]))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def plain(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def end_mark(encoder: WordEncoder) -> int:
    """The id of END, or the vocabulary's last one where it has none."""
    return encoder.names.index(END.encode()) if END.encode() in encoder.names else len(encoder.names) - 1


def sequences(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """buckets, places (in the bucket), doc_ids: of each sequence; payload: their ids, compressed. A row holds those of some documents."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = IdBytes(WordEncoder(path)), zstandard.ZstdCompressor(1)
        if len(words.encoder.names) > 1 << 16:
            raise ValueError(f"{path}: ids don't fit 16 bits")
        end, last, place = end_mark(words.encoder).to_bytes(2, "little"), -1, 0
        for batch in batches:
            for part in slices(batch):
                coded = words.of(part.column(1))
                for start in range(0, part.num_rows, 256):
                    some = part.slice(start, 256)
                    ids, buckets = some.column(0).to_pylist(), some.column(2).to_pylist()
                    rows, owners, of, places = [], [], [], []
                    for i, bucket in enumerate(buckets):
                        data = coded[start + i] + end
                        n = -(-len(data) // (2 * length))
                        rows.append(data.ljust(2 * length * n, b"\0"))
                        last, place = bucket, place if bucket == last else 0  # a bucket's documents come together
                        owners += [ids[i]] * n
                        of += [bucket] * n
                        places += range(place, place + n)
                        place += n
                    columns = [pa.array([of], pa.list_(pa.int32())), pa.array([places], pa.list_(pa.int64())), pa.array([owners], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(rows))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["buckets", "places", "doc_ids", "payload"])

    rows = id_and_text(docs).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS)).cast("int"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")
    return rows.mapInArrow(run, "buckets array<int>, places array<long>, doc_ids array<long>, payload binary")


def training_order(docs: DataFrame, key: int = 11, length: int = LENGTH, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """shard, block, first_slot, n_sequences, stride (bytes), doc_ids (by slot), payload: the sequences of each range of slots, uncompressed, in slot order."""
    packs = materialize(sequences(docs, length, path), "sequences")
    starts = np.zeros(BUCKETS + 1, np.int64)
    for r in packs.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).toLocalIterator():
        starts[r.b + 1] = r.n
    starts = np.cumsum(starts)
    total = int(starts[-1])
    shards = -(-total // (block * SHARD_BLOCKS))
    parts = max(1, min(shards, MOST_PARTS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, unpack = Feistel(max(total, 1), key), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                of, places, owners = (batch.column(c)[i].values for c in range(3))
                slots = order.slots((starts[of.to_numpy()] + places.to_numpy()).astype(np.uint64))
                data = unpack.decompress(batch.column(3)[i].as_py(), max_output_size=2 * length * len(slots))
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(slots), [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(slots), owners, rows], ["slot", "doc_id", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, owners, payload = -1, [], []

        def made() -> pa.RecordBatch:
            columns = [pa.array([at]), pa.array([owners], pa.list_(pa.int64())), pa.array([len(owners)]), pa.array([b"".join(payload)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "n_sequences", "payload"])

        for batch in batches:
            blocks = batch.column(0).to_numpy() // block
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if blocks[lo] != at:
                    if at >= 0:
                        yield made()
                    at, owners, payload = int(blocks[lo]), [], []
                owners += batch.column(1).slice(lo, hi - lo).to_pylist()
                payload += batch.column(2).slice(lo, hi - lo).to_pylist()
        if at >= 0:
            yield made()

    rows = packs.mapInArrow(spread, "slot long, doc_id long, ids binary")
    part = F.expr(f"cast((slot div {block * SHARD_BLOCKS}) * {parts} div {max(shards, 1)} as int)")
    out = rows.repartitionById(parts, part).sortWithinPartitions("slot").mapInArrow(gather, "block long, doc_ids array<long>, n_sequences long, payload binary")
    return out.select(F.expr(f"block div {SHARD_BLOCKS}").alias("shard"), "block", (F.col("block") * block).alias("first_slot"), "n_sequences", F.lit(2 * length).alias("stride"), "doc_ids", "payload")


def write_shards(docs: DataFrame, folder: str, **how) -> None:
    """The blocks as Parquet files: each file holds one range of slots, in order."""
    training_order(docs, **how).write.option("compression", "zstd").parquet(folder)


def sequences_from(spark: SparkSession, folder: str, slot: int, n: int | None = None) -> DataFrame:
    """slot, doc_id, ids of written shards from ``slot`` on, ``n`` of them or all: a reader resumes by slot number; files and row groups before it are skipped."""
    rows = spark.read.parquet(folder).where((F.col("first_slot") + F.col("n_sequences") > slot) & (F.lit(True) if n is None else F.col("first_slot") < slot + n))
    first = spark.read.parquet(folder).agg(F.max("n_sequences")).first()[0]  # all blocks but the last have this many
    rows = rows.where(F.col("block") >= slot // first) if first else rows
    out = rows.select("first_slot", "stride", "payload", F.posexplode("doc_ids").alias("at", "doc_id"))
    out = out.select((F.col("first_slot") + F.col("at")).alias("slot"), "doc_id", F.substr("payload", F.col("at") * F.col("stride") + 1, F.col("stride")).alias("ids"))
    return out.where((F.col("slot") >= slot) & (F.lit(True) if n is None else F.col("slot") < slot + n))

"""Removal of passages that a document with a smaller id has too, by prefix doubling.

The method ranks positions by the string that starts there: names of strings of length 2 h come from pairs of names of
length h, up to 50, and positions whose string is unique drop out early. Plain prefix doubling shuffles a row for every byte
in every round, which no budget bears. Here names are 64-bit hashes, equal for equal strings in every document, so that
doubling (1, 2, 4, 8, 16, 32, 50) needs no exchange, and Spark sorts names only to find out who has them first:

1. Texts: rows with the same whole text are settled by their digest; the smallest id stays in play.
2. Anchors: of every 50 bytes in a row, the 32-byte strings with the least name (local minima, so equal passages have equal
   anchors). Anchors whose name no other text has drop out. Their density is about one in 10 bytes.
3. Contexts: all bytes that windows of an anchor reach (68 at most). Where a smaller id has the same context, every window
   of the anchor is settled at once; this covers the inside of long repeats.
4. Windows: at anchors with several contexts, the edges of repeats, every 50-byte string's name.

Hot names don't gather: a batch or bucket sends one entry for a name, with its smallest id, and answers the others itself.
Names travel in packed arrays, dealt by name to buckets whose number follows the bytes of the table; answers travel back by
a hash of the id. Names are 64 bits (48 in step 2, which only decides what to look at): an error takes a collision of names.

Defined cases: null text counts as empty. A null id: nothing is removed and nothing is provided. Rows that repeat an id are
each judged by their own text. Texts under 50 bytes lose nothing. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_and_text, materialize, mix

LENGTH, GRAM = 50, 32
REACH = LENGTH - GRAM  # windows that hold an anchor begin at most so far before it
BUCKET_BYTES, LEAST_BUCKETS, SLICE = 16 << 20, 64, 2 << 20
MESSAGE = "p long, kind string, ids binary, names binary, more binary"
_BYTE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)
LOW48 = np.uint64((1 << 48) - 1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of joined strings from names of their halves."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def doubled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of 32 and of 50 bytes that start at each place of ``data`` (at least 50 bytes)."""
    one = _BYTE[data]
    for h in (1, 2, 4, 8, 16):
        one = pair(one[:-h], one[h:])
    return one, pair(one[: GRAM - LENGTH], one[LENGTH - GRAM :])


def anchors(gram: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places whose 32-byte name is the least of a window; ``valid`` marks the starts of whole windows."""
    h = (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = h
    for w in (1, 2, 4, 8):
        least = np.minimum(least[:-w], least[w:])
    least = np.minimum(least[: -(REACH - 15)], least[REACH - 15 :])
    most = np.pad(np.where(valid, least, np.uint32(0)), REACH)
    for w in (1, 2, 4, 8):
        most = np.maximum(most[:-w], most[w:])
    most = np.maximum(most[: -(REACH - 15)], most[REACH - 15 :])
    return np.flatnonzero(h == most)


class Texts:
    """Whole texts laid end to end, with names and places of each."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        if len(self.data) < LENGTH:
            self.gram = self.name = np.empty(0, np.uint64)
            self.valid = np.empty(0, bool)
        else:
            self.gram, self.name = doubled(self.data)
            self.valid = np.zeros(len(self.name), bool)
            edge = np.zeros(len(self.name) + 1, np.int32)
            for s, e in zip(self.starts, self.ends):
                if e - s >= LENGTH:
                    edge[s] += 1
                    edge[e - LENGTH + 1] -= 1
            self.valid = np.cumsum(edge[:-1]) > 0

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def anchors(self) -> np.ndarray:
        return anchors(self.gram, self.valid) if len(self.name) else np.empty(0, np.int64)

    def contexts(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, start and end of what the windows of the anchors at ``places`` reach."""
        doc = self.owner(places)
        lo = np.maximum(self.starts[doc], places - REACH)
        hi = np.minimum(self.ends[doc], places + LENGTH)
        shape = ((hi - lo) * 128 + (places - lo)).astype(np.uint64)
        return pair(pair(self.name[lo], self.name[hi - LENGTH]), mix(shape)), lo, hi


def slices(ids: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Consecutive rows of about SLICE bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i == len(texts) - 1:
            yield np.array(ids[at : i + 1], np.int64), texts[at : i + 1]
            at, size = i + 1, 0


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Python's side of bucket(): where an id's rows and answers meet."""
    u = ids.view(np.uint64)
    return ((u ^ (u >> np.uint64(7)) ^ (u >> np.uint64(17))) % np.uint64(buckets)).astype(np.int64)


def bucket(doc_id: Column, buckets: int) -> Column:
    """Spark's side of bucket_of()."""
    x = doc_id.bitwiseXOR(F.shiftrightunsigned(doc_id, 7)).bitwiseXOR(F.shiftrightunsigned(doc_id, 17))
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    return (((high % buckets) * ((1 << 32) % buckets) + low % buckets) % buckets).cast("long")  # x as an unsigned number


def squeezed(a: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, compressed; byte by place, so that equal high bytes stand together."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8)[:, :size].T).tobytes())


def unsqueezed(blobs: list[bytes], size: int, dtype: type) -> np.ndarray:
    parts = [np.empty(0, np.uint64)]
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
        out = np.zeros((raw.shape[1], 8), np.uint8)
        out[:, :size] = raw.T
        parts.append(out.reshape(-1).view(np.uint64))
    return np.concatenate(parts).view(dtype)


#: Bytes of names and of marks by kind of message.
SIZES = {"anchor": (6, 4), "=anchor": (6, 1)}


def packed(kind: str, p: np.ndarray, ids: np.ndarray, names: np.ndarray, more: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Messages: a row for each p, with the entries dealt to it, by id."""
    if not len(p):
        return
    of_name, of_more = SIZES.get(kind, (8, 8))
    order = np.lexsort((ids, p))
    p, ids, names = p[order], ids[order], names[order]
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    ends = np.r_[starts[1:], len(p)]
    steps = np.r_[ids[:1], ids[1:] - ids[:-1]]
    steps[starts] = ids[starts]
    cut = lambda a, size: pa.array([squeezed(a[x:y], size) for x, y in zip(starts, ends)], pa.binary())
    marks = pa.array([b""] * len(starts), pa.binary()) if more is None else cut(more[order], of_more)
    yield pa.RecordBatch.from_arrays([pa.array(p[starts]), pa.array([kind] * len(starts), pa.string()), cut(steps, 8), cut(names, of_name), marks], ["p", "kind", "ids", "names", "more"])


def opened_rows(kind: str, rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, names and marks of packed rows of a kind."""
    of_name, of_more = SIZES.get(kind, (8, 8))
    ids = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unsqueezed([r[0]], 8, np.int64)) for r in rows)])
    return ids, unsqueezed([r[1] for r in rows], of_name, np.uint64), unsqueezed([r[2] for r in rows if r[2]], of_more, np.uint64)


def firsts(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries that have the smallest id of their name, one for each name; entries with a larger id than that)."""
    order = np.lexsort((ids, names))
    n, i = names[order], ids[order]
    new = np.r_[True, n[1:] != n[:-1]] if len(n) else np.empty(0, bool)
    top = i[new][np.cumsum(new) - 1] if len(n) else i
    return order[new], order[i > top]


def judged(messages: DataFrame, judge: Callable[[str, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[str, np.ndarray, np.ndarray]]], buckets: int) -> DataFrame:
    """Answers (p: the bucket of the id, kind, ids, names) of ``judge`` on all entries of a kind and p; kinds that begin with = are answers already."""

    def settle(p: int, found: dict[str, list[tuple[bytes, bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
        for kind, rows in found.items():
            for answer, to, what in judge(kind, *opened_rows(kind, rows)):
                yield from packed(answer, bucket_of(to, buckets), to, what)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, {}
        for batch in batches:
            ps, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield batch.take(pa.array([i for i, k in enumerate(kinds) if k[0] == "="], pa.int64()))
            for i, (p, kind) in enumerate(zip(ps, kinds)):
                if kind[0] == "=":
                    continue
                if p != at:
                    yield from settle(at, found)
                    at, found = p, {}
                found.setdefault(kind, []).append(tuple(batch.column(c)[i].as_py() for c in (2, 3, 4)))
        yield from settle(at, found)

    return messages.repartition("p").sortWithinPartitions("p").mapInArrow(run, MESSAGE)


def answered(right: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """ids and names of all answers of a kind."""
    rows = [(i, n, b"") for k, i, n in zip(*(right.column(c).to_pylist() for c in ("kind", "ids", "names"))) if k == kind]
    return opened_rows(kind, rows)[:2]


def among(ids: np.ndarray, names: np.ndarray, of_ids: np.ndarray, of_names: np.ndarray) -> np.ndarray:
    """Whether each (id, name) is one of the others."""
    return np.isin(pair(mix(ids.view(np.uint64)), names), pair(mix(of_ids.view(np.uint64)), of_names))


def repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    docs = id_and_text(docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tags = [xxhash.xxh3_128_digest(t) for t in texts]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(tags, pa.binary()), pa.array([int.from_bytes(t[:8], "little", signed=True) for t in tags], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "tag", "tag64", "sha"])

    base = materialize(docs.mapInArrow(digests, "doc_id long, n_bytes long, tag binary, tag64 long, sha string"), "digests")
    total = base.agg(F.sum("n_bytes").alias("n")).first().n or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    owned = docs.where("doc_id is not null")
    known = base.where("doc_id is not null")
    classes = materialize(known.groupBy("tag").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("tag", "first"), "classes")
    copies = known.join(classes, "tag").where("doc_id > first").select("doc_id", "tag64")

    def copy_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield from packed("=copy", bucket_of(ids, buckets), ids, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))

    def tag64(text: bytes) -> int:
        return int.from_bytes(xxhash.xxh3_128_digest(text)[:8], "little")

    def anchor_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                tags = np.array([tag64(t) for t in texts], np.uint64) | np.uint64(1)
                t = Texts(texts)
                at = t.anchors()
                names, own = t.gram[at] & LOW48, t.owner(at)
                order = np.lexsort((tags[own], names))
                names, own = names[order], own[order]
                new = np.r_[True, names[1:] != names[:-1]] if len(names) else np.empty(0, bool)
                starts = np.flatnonzero(new)
                if not len(starts):
                    continue
                group = np.cumsum(new) - 1
                shared = np.minimum.reduceat(tags[own], starts) != np.maximum.reduceat(tags[own], starts)
                told = np.unique(np.stack([ids[own[shared[group]]].view(np.uint64), names[shared[group]]]), axis=1)
                yield from packed("=anchor", bucket_of(told[0].view(np.int64), buckets), told[0].view(np.int64), told[1])
                mark = np.where(shared, np.uint64(0), tags[own[starts]] & np.uint64(0xFFFFFFFF))  # 0: is shared, needs no answer
                low = np.minimum.reduceat(ids[own], starts)  # of rows with one text only the first id can need the answer
                yield from packed("anchor", (names[starts] >> np.uint64(24)).astype(np.int64) % buckets, low, names[starts], mark)

    def judge_anchors(kind: str, ids: np.ndarray, names: np.ndarray, marks: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        order = np.argsort(names, kind="stable")
        ids, names, marks = ids[order], names[order], marks[order]
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        shared = (np.minimum.reduceat(marks, starts) != np.maximum.reduceat(marks, starts)) | (np.minimum.reduceat(marks, starts) == 0)
        told = np.repeat(shared, np.diff(np.r_[starts, len(names)])) & (marks != 0)
        yield "=anchor", ids[told], names[told]

    sent = owned.mapInArrow(anchor_messages, MESSAGE).unionByName(copies.mapInArrow(copy_messages, MESSAGE))
    first = judged(sent, judge_anchors, buckets)

    def flagged(left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts that have anchors some other text has, without rows that copy an earlier text; and the segments that hold those anchors' contexts, where they lie, and the anchors' places in them."""
        told, names = answered(right, "=anchor")
        copy_ids, copy_tags = answered(right, "=copy")
        out: list[tuple] = []
        p = left.column("p")[0].as_py() if len(left) else 0
        asked = np.isin(left.column("doc_id").to_numpy(), told)
        some = left.filter(pa.array(asked))
        for ids, texts in slices(some.column("doc_id").to_pylist(), [t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()]):
            tags = np.array([tag64(t) for t in texts], np.uint64)
            keep = np.flatnonzero(~among(ids, tags, copy_ids, copy_tags))
            ids, tags, texts = ids[keep], tags[keep], [texts[i] for i in keep]
            t = Texts(texts)
            at = t.anchors()
            own = t.owner(at)
            hit = among(ids[own], t.gram[at] & LOW48, told, names)
            at, own = at[hit], own[hit]
            lo, hi = t.contexts(at)[1:] if len(at) else (at, at)
            for i in np.unique(own):
                mine = own == i
                new = np.r_[True, lo[mine][1:] > hi[mine][:-1]]  # contexts of neighbours overlap; both ends grow with the place
                starts, ends = lo[mine][new], hi[mine][np.r_[new[1:], True]]
                part = np.cumsum(new) - 1
                shift = np.r_[0, np.cumsum(ends - starts)[:-1]] - starts
                sizes = [(x - t.starts[i] if x is starts else x).astype(np.uint32).tobytes() for x in (starts, ends - starts)]
                segments = b"".join(t.data[x:y].tobytes() for x, y in zip(starts, ends))
                out.append((p, int(ids[i]), int(tags[i].view(np.int64)), texts[i], *sizes, segments, (at[mine] + shift[part]).astype(np.uint32).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["p", "doc_id", "tag", "text", "starts", "sizes", "segments", "places"])

    rows = owned.withColumn("p", bucket(F.col("doc_id"), buckets))
    kept = rows.groupBy("p").cogroup(first.groupBy("p")).applyInArrow(flagged, "p long, doc_id long, tag long, text binary, starts binary, sizes binary, segments binary, places binary")
    kept = materialize(kept, "flagged")

    def opened(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Texts, np.ndarray, np.ndarray]]:
        """For a slice of rows: number of the first, row of each segment, segments as texts, anchors and their ids."""
        first, sizes, places = 0, rows.column("sizes").to_pylist(), rows.column("places").to_pylist()
        for ids, joined in slices(rows.column("doc_id").to_pylist(), rows.column("segments").to_pylist()):
            lengths = [np.frombuffer(x, np.uint32).astype(np.int64) for x in sizes[first : first + len(ids)]]
            cuts = [np.r_[0, np.cumsum(x)] for x in lengths]
            t = Texts([text[x:y] for text, c in zip(joined, cuts) for x, y in zip(c[:-1], c[1:])])
            base = np.cumsum([0, *(len(x) for x in joined)])
            at = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + b for x, b in zip(places[first:], base[:-1])])
            of = np.repeat(np.arange(len(ids)), [len(x) for x in lengths])
            yield first, of, t, at, ids[of]
            first += len(ids)

    def context_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t, at, ids in (x for batch in batches for x in opened(batch)):
            names, docs_of, grams = t.contexts(at)[0], ids[t.owner(at)], t.gram[at]
            lead, later = firsts(names, docs_of)
            yield from packed("=same", bucket_of(docs_of[later], buckets), docs_of[later], names[later])
            yield from packed("context", (names[lead] >> np.uint64(20)).astype(np.int64) % buckets, docs_of[lead], names[lead])
            order = np.lexsort((names, grams))
            g, c, d = grams[order], names[order], docs_of[order]
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
            several = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
            told = several[group]
            yield from packed("=several", bucket_of(d[told], buckets), d[told], g[told])
            # each row's document with a single context here must learn of others elsewhere, but rows of one context share one entry
            mark = np.where(several, np.uint64(0), c[starts] | np.uint64(1))
            low = np.minimum.reduceat(d, starts)
            yield from packed("gram", (g[starts] >> np.uint64(20)).astype(np.int64) % buckets, low, g[starts], mark)

    def judge_contexts(kind: str, ids: np.ndarray, names: np.ndarray, marks: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        if kind == "context":
            later = firsts(names, ids)[1]
            yield "=same", ids[later], names[later]
        else:
            yield from ((("=several"), i, n) for _, i, n in judge_anchors(kind, ids, names, marks))

    second = materialize(judged(kept.drop("text").mapInArrow(context_messages, MESSAGE), judge_contexts, buckets), "contexts")

    def covered(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the first row, row and id of each segment, and the segments of a slice; of its anchors start and end of the context, whether a smaller id has it, whether windows are to be looked at."""
        same_as, several_as = answered(right, "=same"), answered(right, "=several")
        for first, of, t, at, ids in opened(left):
            names, lo, hi = t.contexts(at)
            who = ids[t.owner(at)]
            same = among(who, names, *same_as)
            yield first, of, ids, t, lo, hi, same, among(who, t.gram[at], *several_as) & ~same

    def windows(t: Texts, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Starts of the 50-byte strings inside the ranges."""
        if not len(lo):
            return np.empty(0, np.int64)
        edge = np.zeros(len(t.data) + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi - LENGTH + 1, -1)
        return np.flatnonzero(np.cumsum(edge) > 0)

    def window_messages(left: pa.Table, right: pa.Table) -> pa.Table:
        batches: list[pa.RecordBatch] = []
        for _, _, ids, t, lo, hi, _, look in covered(left, right):
            at = windows(t, lo[look], hi[look])
            names, docs_of = t.name[at], ids[t.owner(at)]
            lead, later = firsts(names, docs_of)
            batches += packed("=window", bucket_of(docs_of[later], buckets), docs_of[later], names[later])
            batches += packed("window", (names[lead] >> np.uint64(20)).astype(np.int64) % buckets, docs_of[lead], names[lead])
        return pa.Table.from_batches(batches, schema=pa.schema([("p", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("names", pa.binary()), ("more", pa.binary())]))

    def judge_windows(kind: str, ids: np.ndarray, names: np.ndarray, marks: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        later = firsts(names, ids)[1]
        yield "=window", ids[later], names[later]

    third = judged(kept.drop("text").groupBy("p").cogroup(second.groupBy("p")).applyInArrow(window_messages, MESSAGE), judge_windows, buckets)

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        told, out = answered(right, "=window"), []
        for first, of, ids, t, lo, hi, same, look in covered(left, right):
            at = windows(t, lo[look], hi[look])
            at = at[among(ids[t.owner(at)], t.name[at], *told)]
            edge = np.zeros(len(t.data) + 1, np.int32)
            for a, b in ((lo[same], hi[same]), (at, at + LENGTH)):
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for row in np.unique(of):
                parts = np.flatnonzero(of == row)
                if not gone[t.starts[parts[0]] : t.ends[parts[-1]]].any():
                    continue
                i = first + int(row)
                text = np.frombuffer(left.column("text")[i].as_py(), np.uint8)
                g = np.zeros(len(text), bool)
                for part, start in zip(parts, np.frombuffer(left.column("starts")[i].as_py(), np.uint32)):
                    g[start : start + t.ends[part] - t.starts[part]] = gone[t.starts[part] : t.ends[part]]
                out.append((int(ids[parts[0]]), left.column("tag")[i].as_py(), int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(text[~g].tobytes()).hexdigest()))
        return pa.table([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "tag64", "removed", "spans", "rest"])

    answers = second.unionByName(third)
    cut = kept.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(removed, "id long, tag64 long, removed long, spans long, rest string")
    cut = materialize(cut.distinct(), "cut")
    empty = hashlib.sha256(b"").hexdigest()
    out = base.join(classes, "tag", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)) & (F.col("n_bytes") >= LENGTH))
    out = out.join(cut.withColumnsRenamed({"id": "doc_id"}), ["doc_id", "tag64"], "left")
    whole = lambda yes, name, no: F.when(F.col("copy"), yes).otherwise(F.coalesce(name, no))
    return out.select("doc_id", "n_bytes", whole(F.col("n_bytes"), "removed", F.lit(0)).cast("long").alias("n_removed"), whole(F.lit(1), "spans", F.lit(0)).cast("long").alias("n_spans"), whole(F.lit(empty), "rest", F.col("sha")).alias("kept_sha256"))

"""Near-duplicate documents by circulant MinHash.

Two permutations give every signature coordinate: the first scatters a document's shingles over a circle of
``2**circle_bits`` places, the second numbers those places, and coordinate k is the least number met when the circle is
turned by k. Bands of coordinates propose candidates; links are confirmed on the full shingle sets.

No step makes a row for a pair of documents. Documents with the same set are one class with one representative. Each
representative is first compared with one other: the most central one of its buckets (that with the most bucket mates),
which settles groups around a common original; its mates come to it in blocks. Only buckets that then still hold several
components are looked at further: their members' sets are packed into blocks of bounded size, every block meets every
other of its bucket once, all overlaps of the two come from one inverted index, and what is given back is one link for
each component that joins another. Pairs inside a bucket's largest component are left out, and so are members that share
too few shingles with the whole other block.

Defined cases: no words or null text: an empty set, linked with nothing, kept. Fewer words than the shingle width: the
whole sequence is the one shingle. A null id: never linked, component null, kept. Rows that repeat an id are judged by
their own texts. An empty table gives an empty result. Other columns of the input are ignored. Very long texts: the circle
has 2**23 places; a set that comes near that many shingles shares coordinates with others by chance, which costs
comparisons and changes no result, as links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WordHash, forget, id_and_text, materialize, mix, shingle_set, words_of

#: Members and shingles a block may hold on average; columns of a dense product, entries of a sparse one.
BLOCK, BLOCK_SHINGLES, COLUMNS, ENTRIES = 1024, 1 << 19, 2048, 1 << 21
#: A shingle in more than one of so many pairs of sets is cheaper counted by a dense product.
DENSE = 100
#: Rows of narrow tables that make a file, and the least number of files.
ROWS_A_PART, LEAST_PARTS = 100_000, 12


class Circulant:
    """Signatures of ``bands * rows`` coordinates."""

    def __init__(self, bands: int = 32, rows: int = 4, circle_bits: int = 23, seed: int = 7):
        self.bands, self.rows, self.bits, self.seed = bands, rows, circle_bits, seed
        k, full = bands * rows, np.uint32((1 << circle_bits) - 1)
        numbers = np.arange(1 << circle_bits, dtype=np.uint32)
        for odd in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D):  # each step is a bijection of circle_bits bits
            numbers *= np.uint32(odd)
            numbers += np.uint32(seed)
            numbers &= full
            numbers ^= numbers >> np.uint32(circle_bits // 2)
        self.turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[: k - 1]]), k)
        self.row_mult = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.band_salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = mix(shingles + np.uint64(self.seed)) >> np.uint64(64 - self.bits)
        parts = [self.turned[places[i : i + 2048]].min(0) for i in range(0, len(places), 2048)]
        return parts[0] if len(parts) == 1 else np.min(parts, axis=0)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        sig = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return mix((sig * self.row_mult).sum(1) + self.band_salt).view(np.int64)


@lru_cache(maxsize=1)
def circulant(bands: int, rows: int, seed: int) -> Circulant:
    """One for each worker, which outlives its tasks."""
    return Circulant(bands, rows, seed=seed)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n (set size), fp (digest of the set, null if empty), keys (one for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle, cache = circulant(bands, rows, seed), WordHash()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ns, fps, keys = [], [], [np.empty(0, np.int64)]
            for i in range(len(texts)):
                s = shingle_set(cache.of(words_of(texts[i].as_py())), width)
                ns.append(len(s))
                fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    keys.append(circle.band_keys(circle.signature(s)))
            offsets = np.concatenate([[0], np.cumsum([bands if n else 0 for n in ns])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), lists], ["doc_id", "n", "fp", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """rep (the id), n, hashes: the sets themselves, sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sets = [shingle_set(cache.of(words_of(texts[i].as_py())), width) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "hashes"])

    return docs.mapInArrow(run, "rep long, n long, hashes binary")


def unpacked(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a block, and whose they are."""
    sets = members.field("hashes").to_pylist()
    sizes = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets))
    return np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), sizes)


def led(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of ``pairs`` (a leader, a mate of it) that are links. Mates come in blocks, each with the leader's set."""
    rows = pairs.join(sets, F.col("b") == F.col("rep")).select("a", "b", "n", "hashes")
    parts = pairs.join(sets.select("rep", "n"), F.col("b") == F.col("rep")).groupBy("a").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    rows = rows.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("block"), "b", "hashes")
    own = parts.join(sets, F.col("a") == F.col("rep")).select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("block"), F.lit(None).cast("long").alias("b"), "hashes")
    blocks = rows.unionByName(own).groupBy("a", "block").agg(F.collect_list(F.struct("b", "hashes")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                members = batch.column(1)[i].values
                hashes, whose = unpacked(members)
                leads = np.asarray(members.field("b").is_null())
                ids = members.field("b").fill_null(0).to_numpy(zero_copy_only=False)
                n = np.bincount(whose, minlength=len(ids))
                linked = np.zeros(len(ids), bool)
                for lead in np.flatnonzero(leads):
                    own = hashes[whose == lead]
                    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                    both = np.bincount(whose[own[at] == hashes], minlength=len(ids))
                    linked |= ~leads & (100 * both >= percent * (n + n[lead] - both))
                found = np.unique(ids[linked])
                firsts.append(np.full(len(found), batch.column(0)[i].as_py()))
                seconds.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(seconds))], ["a", "b"])

    return blocks.select("a", "members").mapInArrow(run, "a long, b long")


def overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many hashes each set of ``x`` shares with each of ``y``, both given by (hashes, whose)."""
    out = np.zeros(shape, np.int64)
    known, xs = np.unique(x[0], return_inverse=True)
    if not len(known) or not len(y[0]):
        return out
    at = np.minimum(np.searchsorted(known, y[0]), len(known) - 1)
    there = known[at] == y[0]
    ys, y_of, x_of = at[there], y[1][there], x[1]
    x_df, y_df = np.bincount(xs, minlength=len(known)), np.bincount(ys, minlength=len(known))
    dense = x_df * y_df * DENSE > shape[0] * shape[1]
    places = np.flatnonzero(dense)
    number = np.full(len(known), -1)
    number[places] = np.arange(len(places))
    for lo in range(0, len(places), COLUMNS):
        a, b = (np.zeros((rows, min(COLUMNS, len(places) - lo)), np.float32) for rows in shape)
        for block, columns, of in ((a, number[xs], x_of), (b, number[ys], y_of)):
            inside = (columns >= lo) & (columns < lo + COLUMNS)
            block[of[inside], columns[inside] - lo] = 1
        out += (a @ b.T).astype(np.int64)
    order = np.argsort(ys, kind="stable")
    begins = np.concatenate([[0], np.cumsum(y_df)])
    rare = ~dense[xs] & (y_df[xs] > 0)
    first, count, row = begins[xs[rare]], y_df[xs[rare]], x_of[rare]
    upto = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - count[lo] + ENTRIES)))
        c = count[lo:hi]
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        cells = np.repeat(row[lo:hi] * shape[1], c) + y_of[order[np.repeat(first[lo:hi], c) + step]]
        out += np.bincount(cells, minlength=out.size).reshape(shape)
        lo = hi
    return out


def joined(x: pa.StructArray, y: pa.StructArray | None, major: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (component, component) that join what two blocks of a bucket, or one with itself, hold; at most one for each component."""
    blocks = []
    for members in (x,) if y is None else (x, y):
        hashes, whose = unpacked(members)
        comp = members.field("comp").to_numpy(zero_copy_only=False)
        blocks.append((hashes, whose, comp, np.bincount(whose, minlength=len(comp))))
    pairs = [(blocks[0], blocks[0], True)] if y is None else [(blocks[0], blocks[1], True), (blocks[0], blocks[1], False)]
    edges = [np.empty((2, 0), np.int64)]
    for p, q, first in pairs:  # the largest component meets only the others
        out = []
        for (hashes, whose, comp, n), ours in ((p, (p[2] != major) if first else (p[2] == major)), (q, np.ones(len(q[2]), bool) if first else (q[2] != major))):
            there = ours[whose]
            out.append((hashes[there], whose[there], comp, n))
        (xh, xo, xc, xn), (yh, yo, yc, yn) = out
        if not len(xh) or not len(yh):
            continue
        known, number = np.unique(np.concatenate([xh, yh]), return_inverse=True)
        a, b = number[: len(xh)], number[len(xh) :]
        if y is None:  # each set is on both sides
            x_ok = np.bincount(b, minlength=len(known))[a] > 1
            y_ok = np.bincount(a, minlength=len(known))[b] > 0
        else:
            x_ok = np.bincount(b, minlength=len(known))[a] > 0
            y_ok = np.bincount(a, minlength=len(known))[b] > 0
        kept = []
        for h, o, ok, n in ((a, xo, x_ok, xn), (b, yo, y_ok, yn)):  # a link needs that share of the set
            rows = np.flatnonzero((100 * np.bincount(o[ok], minlength=len(n)) >= percent * n) & (np.bincount(o, minlength=len(n)) > 0))
            place = np.full(len(n), -1)
            place[rows] = np.arange(len(rows))
            use = ok & (place[o] >= 0)
            kept.append((h[use], place[o[use]], rows))
        (a, ao, ar), (b, bo, br) = kept
        if not len(ar) or not len(br):
            continue
        both = overlaps((a, ao), (b, bo), (len(ar), len(br)))
        if y is None:
            both[ar[:, None] == br] = 0
        ok = (100 * both >= percent * (xn[ar][:, None] + yn[br] - both)) & (xc[ar][:, None] != yc[br])
        i, j = np.nonzero(ok)
        edges.append(np.unique(np.stack([xc[ar[i]], yc[br[j]]]), axis=1))
    u, v = np.concatenate(edges, axis=1)
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = flat[: len(u)], flat[len(u) :]
    top = np.arange(len(names))
    while (top[u] != top[v]).any():
        new = top.copy()
        np.minimum.at(new, u, top[v])
        np.minimum.at(new, v, top[u])
        top = new[new]
    moved = top != np.arange(len(names))
    return names[top[moved]], names[moved]


def alike(buckets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components that meet in a bucket. ``buckets``: key, parts, major, and rep, comp, hashes of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.empty(0, np.int64),) * 2]
            for i in range(batch.num_rows):
                other = None if batch.num_columns == 2 else batch.column(2)[i].values
                out.append(joined(batch.column(1)[i].values, other, batch.column(0)[i].as_py(), percent))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], ["a", "b"])

    packed = buckets.withColumn("block", F.pmod(F.xxhash64("rep"), "parts")).groupBy("key", "major", "parts", "block").agg(F.collect_list(F.struct("comp", "hashes")).alias("members"))
    packed = materialize(packed, "packed")
    within = packed.select("major", "members").mapInArrow(run, "a long, b long")
    many = packed.where("parts > 1")
    x, y = many.alias("x"), many.alias("y")
    across = x.join(y, F.expr("x.key = y.key and x.block < y.block")).select("x.major", F.col("x.members").alias("m"), F.col("y.members").alias("o")).mapInArrow(run, "a long, b long")
    return within.union(across).distinct()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """id, component: the least id reachable over the links (a, b), for the ids that have links. Alternates large and small stars until all edges lead to tops."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges", parts)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", parts)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "large", parts)
        small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least", parts)
        small = large.join(small_least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.distinct(), "edges", parts)
        forget(before, least, large, small_least)
        several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")  # an id under two tops
        if several.isEmpty() and edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").isEmpty():
            break
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; links have 100 * intersection >= percent * union."""
    docs = id_and_text(docs)
    sig = materialize(signatures(docs, width, bands, rows, seed), "signatures")
    parts = max(LEAST_PARTS, -(-sig.count() // ROWS_A_PART))  # files of tables that have a few numbers for each document
    ids = sig.where("doc_id is not null and fp is not null")
    classes = materialize(ids.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("fp", "rep"), "classes", parts)
    reps = ids.join(classes, "fp", "left").where("rep is null or rep = doc_id").select(F.col("doc_id").alias("rep"), "n", "keys")
    entries = reps.select("rep", "n", F.explode("keys").alias("key"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")
    shared = materialize(entries.groupBy("key").agg(F.count("*").alias("size"), blocks, F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "size", "parts"), "shared", parts)
    members = materialize(entries.drop("n").join(shared, "key"), "members", parts)
    mates = materialize(members.groupBy("rep").agg(F.sum("size").alias("mates")), "mates", parts)
    ranked = members.join(mates, "rep").select("key", "rep", F.struct("mates", (-F.col("rep")).alias("minus")).alias("rank"))
    leaders = materialize(ranked.groupBy("key").agg(F.max("rank").alias("leader")), "leaders", parts)
    sets = materialize(shingle_sets(docs.join(mates.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), width).where("n > 0"), "sets")
    first = members.join(leaders, "key").groupBy(F.col("rep").alias("b")).agg((-F.max("leader")["minus"]).alias("a")).where("a <> b").select("a", "b")
    comp = materialize(components(led(materialize(first, "first", parts), sets, percent), parts), "components", parts)
    placed = materialize(members.join(comp, members.rep == comp.id, "left").select("key", "parts", "rep", F.coalesce("component", "rep").alias("comp")), "placed", parts)
    counted = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    mixed = counted.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("major"), F.count("*").alias("several")).where("several > 1").select("key", "major")
    buckets = placed.join(materialize(mixed, "mixed", parts), "key").join(sets.select("rep", "hashes"), "rep")
    more = materialize(alike(buckets, percent), "more", parts)
    last = comp.select("id", F.col("component").alias("was"))
    if not more.isEmpty():
        new = materialize(components(more, parts), "joined", parts).select(F.col("id").alias("was"), F.col("component").alias("now"))
        met = new.select("was").join(comp.select(F.col("component").alias("was")), "was", "left_anti").select(F.col("was").alias("id"), "was")  # not linked with a leader
        last = last.union(met).join(new, "was", "left").select("id", F.coalesce("now", "was").alias("was"))
    known = classes.select("rep").union(last.select("id")).distinct()
    of_rep = known.join(last, known.rep == last.id, "left").select(F.col("rep").alias("r"), F.coalesce("was", "rep").alias("component"))
    of_rep = materialize(of_rep, "of_rep", parts)
    forget(shared, members, mates, leaders, sets, comp, placed, more)
    shown = sig.select("doc_id", "n", "fp").join(classes, "fp", "left").withColumn("r", F.coalesce("rep", "doc_id"))
    top = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return shown.join(of_rep, "r", "left").select("doc_id", F.col("n").alias("n_shingles"), top.alias("component_id"), F.coalesce(F.col("doc_id") == top, F.lit(True)).alias("kept"))

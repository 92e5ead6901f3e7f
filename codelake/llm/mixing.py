"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share all words by weight; a source gives at most ``cap`` times its size, and what exceeds that is shared again.
The mix is cut into at most ``seats`` blocks of equal size, and blocks go to sources by the highest quotients
target / (2 s + 1); a block's place in that order also fixes its shard, so every shard has an integer quota of each
source. A source with a quota over its size is taken whole as often as that fits; the rest are blocks of its running
text, chosen by a seeded hash. Sources whose size or target is under FEW blocks are too small for that measure, where a
block has more than one word: their quotas are their targets in words, rounded so that their sum keeps to the targets',
and the last block chosen is taken only as far as its quota goes. The other sources share the rest. Documents stand in a source by (hash bucket of the id, id), so no step needs a source's
rows in one task: sizes are summed by bucket, buckets by source, and only tables of sources, of (source, bucket) and of at
most ``seats`` blocks are ordered as a whole.

Defined cases: null or empty text: size 0, taken 0. A null source is a source of its own, last. Null ids share a bucket.
Repeated rows count each by itself, ties in order go by size. An empty table gives an empty result. Extra columns are
ignored by mix(); mixed_documents() carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, materialize

WEIGHTS = (5, 2, 1)
CAP, SEATS, SHARDS, SEED = 3, 65_536, 16, 17
#: Sources under so many blocks get words instead.
FEW = 256


def word_count(text: Column) -> Column:
    """Words of the word rule: the pieces between white space, without an empty first or last one."""
    edge = lambda p: text.rlike(p).cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.size(F.split(text, SPACE, -1)) - edge(f"^{SPACE}") - edge(SPACE + "\\z")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    bucket = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 3), 16, 10).cast("int"), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")).withColumn("bucket", bucket)


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, k (its place), target. One row for each source."""
    at = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    s = per_source.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", at)
    s = s.withColumn("most", F.col("source_size") * float(cap)).withColumn("r", F.col("most") / F.col("w"))
    order = W.orderBy("r", "k")
    s = s.withColumn("held", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    before = F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("open", F.sum("w").over(W.partitionBy()) - before)  # not a frame to the end, which costs the square of the sources
    s = s.withColumn("all", F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("unit", (F.col("all").cast("double") - F.col("held")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("r") >= F.col("unit"), F.struct("r", "k", "unit"))).over(W.partitionBy())["unit"])
    return s.select("source", "source_size", "k", "all", F.least("most", F.col("w") * F.col("level")).alias("target"))


def measured(goals: DataFrame, cap: int = CAP, seats: int = SEATS) -> DataFrame:
    """``goals`` with block (its size), words (the quota of a source under FEW blocks; null for others)."""
    g = goals.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("all") / seats)).cast("long"))
    few = (F.col("block") > 1) & (F.least(F.col("source_size").cast("double"), F.col("target")) < FEW * F.col("block"))
    g = g.withColumn("few", F.coalesce(few, F.lit(False)))
    upto = F.round(F.sum("target").over(W.partitionBy("few").orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    g = g.withColumn("upto", upto.cast("long"))
    words = F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("few").orderBy("k")), F.lit(0))
    return g.withColumn("words", F.when(F.col("few"), F.least(words, F.col("source_size") * cap))).drop("few", "upto")


def quotas(goals: DataFrame, cap: int = CAP, seats: int = SEATS, shards: int = SHARDS) -> DataFrame:
    """k, shard, blocks: how many blocks of which source each shard has; with block (its size), source_size. Sources with words are left out."""
    g = goals if "words" in goals.columns else measured(goals, cap, seats).withColumn("words", F.lit(None).cast("long"))
    g = g.withColumn("given", F.coalesce(F.sum("words").over(W.partitionBy()), F.lit(0)))
    g = g.withColumn("total", F.round((F.col("all") - F.col("given")) / F.col("block")).cast("long"))
    most = F.least(F.floor(F.col("source_size") * cap / F.col("block")), F.ceil(F.col("target") / F.col("block")) + 2).cast("int")
    seat = g.where(F.col("words").isNull() & (most > 0)).select("k", "source_size", "block", "total", "target", F.explode(F.sequence(F.lit(0), most - 1)).alias("s"))
    seat = seat.withColumn("place", F.row_number().over(W.orderBy((F.col("target") / (2 * F.col("s") + 1)).desc(), "k")) - 1).where("place < total")
    return seat.groupBy("k", (F.floor(F.col("place") * shards / F.col("total"))).cast("int").alias("shard")).agg(F.count("*").alias("blocks"), F.first("block").alias("block"), F.first("source_size").alias("source_size"))


def chosen_blocks(quota: DataFrame, goals: DataFrame, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """k, block, full (how often the source is taken whole), b (a block taken once more; null where there is none), upto (how many of its words)."""
    q = quota.groupBy("k").agg((F.sum("blocks") * F.first("block")).alias("q"), F.first("block").alias("block"), F.first("source_size").alias("size"))
    q = q.withColumn("q", F.least("q", F.col("size") * cap)).withColumn("full", F.expr("q div size"))
    q = q.withColumn("more", F.round((F.col("q") - F.col("full") * F.col("size")) / F.col("block")).cast("long") * F.col("block")).select("k", "block", "size", "full", "more", F.lit(False).alias("exact"))
    few = goals.where("words is not null and source_size > 0").select("k", "block", F.col("source_size").alias("size"), F.expr("words div source_size").alias("full"), F.expr("words % source_size").alias("more"), F.lit(True).alias("exact"))
    q = q.unionByName(few)
    b = q.select("k", "block", "size", "full", "more", "exact", F.explode(F.expr("sequence(0, (size - 1) div block)")).alias("b"))
    b = b.withColumn("long", F.when(F.col("exact"), F.least("block", F.col("size") - F.col("b") * F.col("block"))).otherwise(F.col("block")))
    turn = W.partitionBy("k").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "k", "b")), "b")
    b = b.withColumn("ahead", F.sum("long").over(turn.rowsBetween(W.unboundedPreceding, 0)) - F.col("long"))
    picked = b.where("ahead < more").select("k", "b", F.least("long", F.col("more") - F.col("ahead")).alias("upto"))
    return q.select("k", "block", "full").join(picked, "k", "left")


def placed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seats: int = SEATS, seed: int = SEED) -> DataFrame:
    """Each row of sizes() with source_size, target, start (its first word's place in the source), full, block, and pieces: the word ranges taken once more."""
    rows = materialize(rows, "sizes")
    per_bucket = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    goals = materialize(targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap).transform(measured, cap, seats), "targets")
    blocks = materialize(chosen_blocks(quotas(goals, cap, seats), goals, cap, seed), "blocks")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("first", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    taken = blocks.select("k", "block", "full").distinct()
    g = goals.join(taken, "k", "left").select(F.col("source").alias("s"), "k", "source_size", "target", F.coalesce(taken["block"], goals["block"]).alias("block"), F.coalesce("full", F.lit(0)).alias("full"))
    per_bucket = materialize(per_bucket.join(g, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("bucket").alias("u"), "first", "k", "source_size", "target", "block", "full"), "placed")
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "size")
    r = rows.withColumn("pos", F.row_number().over(inside)).withColumn("ahead", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    r = r.join(per_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("u"))).withColumn("start", F.col("first") + F.col("ahead"))
    touched = F.when(F.col("size") > 0, F.expr("sequence(start div block, (start + size - 1) div block)"))
    r = r.select("doc_id", "source", "bucket", "pos", "size", "source_size", "target", "start", "block", "full", "k", F.explode_outer(touched).alias("b"))
    r = r.join(blocks.where("b is not null").select("k", "b", "upto"), ["k", "b"], "left")
    piece = F.when(F.expr("start < b * block + upto"), F.struct((F.greatest("start", F.expr("b * block")) - F.col("start")).alias("from"), (F.least(F.col("start") + F.col("size"), F.expr("b * block + upto")) - F.col("start")).alias("to")))
    by = ["k", "bucket", "pos", "doc_id", "source", "size", "source_size", "target", "start", "full"]
    return r.groupBy(*by).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    more = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p.to - p["from"])
    return placed(sizes(docs), **how).select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + more).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken whole, and one for each run of its words that is taken besides."""
    columns = docs.columns
    # rows are told apart by id, size and source, so that a frequent (or null) id is no hot key; texts are shuffled once, by that key
    key = lambda i, size, source: F.xxhash64(i, size, source, source.isNull(), i.isNull())
    plan = placed(sizes(docs), **how).select(key(F.col("doc_id"), F.col("size"), F.col("source")).alias("key"), "start", "size", "full", "pieces")
    plan = plan.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("start", "size", "full", "pieces"))).alias("taken"))
    plan = materialize(plan.where(F.exists("taken", lambda x: (x.full > 0) | (F.size(x.pieces) > 0))), "plan")
    text = F.col("text").cast("string")
    own = docs.select(key(F.col("doc_id").cast("long"), word_count(text), F.col("source").cast("string")).alias("key"), word_count(text).alias("size"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    own = own.withColumn("n", F.row_number().over(W.partitionBy("key", "size").orderBy(F.xxhash64(F.col("row.text").cast("string")))))
    both = own.join(plan, ["key", "size"]).select("row", F.get("taken", F.col("n") - 1).alias("t")).select("row", "t.size", "t.full", "t.pieces").where("full > 0 or size(pieces) > 0")
    runs = "aggregate(pieces, cast(array() as array<struct<from:bigint,to:bigint>>), (a, p) -> if(size(a) > 0 and get(a, size(a) - 1).to = p.from, concat(slice(a, 1, size(a) - 1), array(struct(get(a, size(a) - 1).from as from, p.to as to))), concat(a, array(p))))"
    whole = "if(full > 0, array_repeat(struct(0L as from, size as to), cast(full as int)), cast(array() as array<struct<from:bigint,to:bigint>>))"
    both = both.withColumn("run", F.explode(F.expr(f"concat({whole}, {runs})")))
    text = F.expr(f"if(run.to - run.from = size, row.text, array_join(slice(filter(split(row.text, r'{SPACE}'), x -> x <> ''), cast(run.from as int) + 1, cast(run.to - run.from as int)), ' '))")
    out = both.select("row", text.alias("_new"))
    return out.select(*(F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in columns))


def oracle(weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seats: int = SEATS, seed: int = SEED) -> str:
    return f"""
with sized as (
  select doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::bigint as size,
    coalesce(('0x' || substr(md5(doc_id::varchar), 1, 3))::int, 0) as bucket from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as k from per_source),
s2 as (select *, list_extract({list(map(float, weights))}, (k % {len(weights)} + 1)::int)::double as w, source_size * {float(cap)}::double as most from s1),
s3 as (select *, most / w as r, sum(source_size) over () as total_words from s2),
s4 as (select *, coalesce(sum(most) over (order by r, k rows between unbounded preceding and 1 preceding), 0.0) as held,
  sum(w) over (order by r, k rows between current row and unbounded following) as open from s3),
s5 as (select *, (total_words::double - held) / open as unit from s4),
s6 as (select *, (select unit from s5 where r >= unit order by r, k limit 1) as level from s5),
goals as (select source, source_size, k, least(most, w * level) as target, greatest(1, ceil(total_words / {seats}::double))::bigint as block, total_words from s6),
seats as (select k, row_number() over (order by target / (2 * s + 1) desc, k) - 1 as place, round(total_words / block::double)::bigint as total
  from (select *, unnest(range(0, least(floor(source_size * {cap} / block::double), ceil(target / block) + 2)::bigint)) as s from goals)),
q1 as (select g.k, g.block, g.source_size as size, least(count(*) * g.block, g.source_size * {cap})::bigint as q from seats join goals g using (k) where place < total group by g.k, g.block, g.source_size),
q2 as (select *, q // size as full_times, round((q - (q // size) * size) / block::double)::bigint as more from q1),
picked as (select k, b from (select k, b, more, row_number() over (partition by k order by md5('{seed}:' || k || ':' || b), b) as turn
  from (select k, more, unnest(range(0, (size - 1) // block + 1)) as b from q2)) where turn <= more),
spots as (select z.*, g.k, g.source_size, g.target, g.block, coalesce(q.full_times, 0) as full_times,
    sum(z.size) over (partition by z.source order by z.bucket, z.doc_id, z.size rows unbounded preceding) - z.size as start,
    row_number() over () as row_id
  from sized z join goals g on z.source is not distinct from g.source left join q2 q on q.k = g.k),
parts as (select row_id, sum(least(start + size, (b + 1) * block) - greatest(start, b * block)) as words
  from (select row_id, k, start, size, block, unnest(range((start // block)::bigint, ((start + size - 1) // block)::bigint + 1)) as b from spots where size > 0) join picked using (k, b) group by row_id)
select doc_id, size, source_size, target, (full_times * size + coalesce(words, 0))::bigint as taken, source from spots left join parts using (row_id)"""

"""Mixing sources to target weights: exact quotas, a multivariate-hypergeometric splitting tree and permuted blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources, or groups of them, that one task splits; more make a tree of groups.
FAN = 4_096
#: Sources up to which their table of targets is broadcast; beyond that it is joined by a shuffle.
BROADCAST = 100_000
#: Output shards where their number isn't given are at most MAX_SHARDS.  Blocks get larger so that there are at most about MAX_BLOCKS.
MAX_SHARDS, MAX_BLOCKS = 65_536, 50_000_000
#: Blocks that a source has for each shard, at least, as far as its documents go.
SPREAD = 16
#: Rows of one source in a window of the permutations.
BUCKET = 4_096
SEED = 11


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with idx, its place in the order from 0: places inside range partitions, and the sizes of the partitions before."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(parts.select("_part", before.alias("_start")), "_part").withColumn("idx", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sizes(source, size): one row per source (null is a source): source, source_size, docs, idx, target.

    Sources by code point, null last, get the weights in turn and share `share` times all sizes.  A
    target stops at `most` times its source's size and the excess is shared again by weight until none
    is above: each round is one aggregation over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    per = written(_numbered(per, F.col("source").isNull(), F.col("source")).withColumn("weight", weight), "sources")
    cap, level, capped = most * F.col("source_size"), None, -1
    while True:
        full = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        now = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.count(F.when(full, F.lit(1))).alias("n")).first()
        if now.n == capped or not now.free:
            break
        capped, level = now.n, (share * now.all - most * (now.held or 0)) / now.free
    target = cap if level is None or not now.free else F.least(cap, F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", "docs", "idx", target.alias("target"))


def split(have: np.ndarray, take: np.ndarray, seed: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal have[c] blocks of every child c to shards that get take[s] blocks each: (child, shard, number) where some are.

    At every node of a binary tree over the shards the blocks that go left are drawn without replacement:
    one multivariate-hypergeometric draw over the children.
    """
    ends = np.concatenate([[0], np.cumsum(take)])
    out, todo = [], [(0, len(take), np.flatnonzero(have), have[have > 0].astype(np.int64))]
    while todo:
        lo, hi, at, n = todo.pop()
        if not len(at):
            continue
        if hi - lo == 1:
            out.append((at, np.full(len(at), lo), n))
            continue
        mid = (lo + hi) // 2
        digest = hashlib.sha256(f"{seed}/{len(take)}/{lo}/{hi}".encode()).digest()
        left = np.random.default_rng(int.from_bytes(digest[:8], "little")).multivariate_hypergeometric(n, int(ends[mid] - ends[lo]), method="marginals")
        for a, b, m in ((lo, mid, left), (mid, hi, n - left)):
            todo.append((a, b, at[m > 0], m[m > 0]))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _dealer(seed: str):
    """split() over the members of one group and the shares that shards have of it, as tables."""

    def deal(members: pa.Table, shares: pa.Table) -> pa.Table:
        if not len(members) or not len(shares):
            return pa.table({c: pa.array([], pa.int64()) for c in ("parent", "shard", "start", "n")})
        order, places = np.argsort(np.asarray(members.column("child"))), np.argsort(np.asarray(shares.column("shard")))
        names, have = np.asarray(members.column("child"))[order], np.asarray(members.column("n"))[order]
        shard, take = np.asarray(shares.column("shard"))[places], np.asarray(shares.column("n"))[places]
        c, s, n = split(have, take, f"{seed}/{members.column('parent')[0].as_py()}")
        order = np.lexsort((s, c))
        c, s, n = c[order], s[order], n[order]
        ends = np.cumsum(n)
        first = np.searchsorted(c, c)
        return pa.table({"parent": names[c], "shard": shard[s], "start": ends - n - (ends[first] - n[first]), "n": n})

    return deal


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """Blocks of each source for each shard: quotas(idx, n) -> idx, shard, start (of the source's blocks, before this shard), n.

    Shards get equal numbers of blocks, but for one.  Up to `fan` sources are split by one task; more
    are grouped by their numbers, groups are split first and every group's blocks then among its members,
    a task for each group, so a task holds `fan` numbers and a row per shard, whatever the input.
    """
    spark = quotas.sparkSession
    quotas = written(quotas, "quotas")
    size = quotas.agg(F.count("*").alias("sources"), F.coalesce(F.max("idx"), F.lit(0)).alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks")).first()
    if size.blocks >= 1_000_000_000:
        raise ValueError("more than 10**9 blocks; use larger ones")
    levels = 1
    while fan**levels <= size.last:
        levels += 1
    cut = lambda i: F.floor(i * F.lit(size.blocks) / shards)
    held = spark.range(shards).select(F.lit(0).cast("long").alias("parent"), F.col("id").alias("shard"), (cut(F.col("id") + 1) - cut(F.col("id"))).alias("n"))

    for level in range(levels - 1, -1, -1):
        child = F.floor(F.col("idx") / fan**level)
        totals = quotas.groupBy(child.alias("child")).agg(F.sum("n").alias("n")).select(F.floor(F.col("child") / fan).alias("parent"), "child", "n")

        held = totals.groupBy("parent").cogroup(held.select("parent", "shard", "n").groupBy("parent")).applyInArrow(_dealer(f"{seed}/{level}"), "parent long, shard long, start long, n long")
        held = written(held, "shard-quotas")
    return held.withColumnRenamed("parent", "idx")


def _before(df: DataFrame, seed: int, names: tuple[str, ...], buckets: Column, value: Column, out: str) -> DataFrame:
    """df(idx, ...) with `out`: the sum of value over the rows of the same idx that come before in a permutation.

    The permutation is by bucket, then hash, of the named columns; sums are taken inside buckets of
    about BUCKET rows and over buckets, so a hot source isn't one task's.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "idx", *names), F.greatest(F.lit(1), buckets))).withColumn("_v", value)
    whole = df.groupBy("idx", "_b").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy("idx").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("idx", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("idx", "_b").orderBy(F.xxhash64(F.lit(seed + 1), "idx", *names), *names).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return df.join(whole, ["idx", "_b"]).withColumn(out, F.col("_s") + F.col("_i")).drop("_b", "_v", "_s", "_i")


def _drawn(docs: DataFrame, carry: bool, weights: tuple[float, ...], share: float, most: float, shards: int | None, block_docs: int, seed: int) -> DataFrame:
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"), key.alias("h"), *row)
    sizes = written(rows.drop("row"), "sizes")
    rows = rows if carry else sizes
    per = written(source_targets(sizes, weights, share, most), "targets")
    count = per.agg(F.count("*").alias("sources"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    block_docs = max(block_docs, -(-count.docs // MAX_BLOCKS))
    if shards is None:  # about 64 whole blocks each
        shards = max(8, min(count.docs // (64 * block_docs), MAX_SHARDS))
    least = min(SPREAD * shards, MAX_BLOCKS // max(1, count.sources))  # blocks of a source, if it has so many documents
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(int(most)))
    known = per.select(F.col("source").alias("s"), "idx", "source_size", "target", F.greatest(F.ceil(F.col("docs") / block_docs), F.least("docs", F.lit(least))).alias("blocks"), passes.alias("passes"))
    known = known.withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    near = F.broadcast if count.sources <= BROADCAST else lambda x: x.hint("merge")

    def dealt(x: DataFrame) -> DataFrame:
        x = x.join(near(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        return x.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("blocks")))

    blocks = dealt(sizes).groupBy("idx", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("blocks", "passes", "rest"))).where("words > 0")
    blocks = _before(blocks, seed + 2, ("block",), F.ceil(F.col("blocks") / BUCKET), F.col("words"), "block_start")
    times = F.col("passes") + (F.col("block_start") < F.col("rest")).cast("long")
    draws = blocks.where(times > 0).select("idx", "block", "blocks", "block_start", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("pass"))
    draws = written(_before(draws, seed + 4, ("block", "pass"), F.ceil(F.col("blocks") * (int(most) + 1) / BUCKET), F.lit(1), "rank"), "draws")
    quotas = draws.groupBy("idx").agg(F.count("*").alias("n"))
    ranges = shard_quotas(quotas, shards, seed)
    slots = ranges.select("idx", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("rank"))
    of_block = draws.join(slots, ["idx", "rank"]).groupBy("idx", "block").agg(F.first("block_start").alias("block_start"), F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("at"))

    inside = Window.partitionBy("idx", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(rows).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(of_block, ["idx", "block"], "left")
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("block_start") - F.col("before")))
    words = lambda x: F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(part).cast("long")
    draw = F.transform("at", lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 3), "h", x["pass"]).alias("place"), words(x).alias("words")))
    draw = F.coalesce(F.filter(draw, lambda x: x["words"] > 0), F.array().cast("array<struct<shard:bigint,place:bigint,words:bigint>>"))
    taken = lambda d: F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.withColumn("draws", draw).withColumn("taken", taken(F.col("draws")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, block_docs: int = 256, seed: int = SEED) -> DataFrame:
    """Draw docs(doc_id, text, source) to their sources' targets (see source_targets).

    Returns doc_id, size (words), source, source_size, target, taken (words the mix takes, repeats
    counted) and draws: an array of (shard, place, words), one for each time the document is drawn; place
    orders the documents of a shard.  A source is dealt by a hash of the document into blocks of at most about
    `block_docs`, and into SPREAD for each shard if it has so many documents, so no source is too few blocks to be in every shard.  Drawn are
    whole passes over its blocks and then blocks of a permutation up to the exact rounded rest; the
    document at the boundary is taken in part, so taken words of a source differ from its target by
    rounding only and no document exceeds `most` times its size.  The splitting tree deals the numbers of
    drawn blocks of each source to the shards (shard_quotas), and each shard takes so many blocks of a
    second permutation of the drawn ones, so every shard is a sample of the whole mix.

    Everything follows from the seed and the rows, so reruns agree.  Rows equal in doc_id, text and
    source are told apart by nothing: as a bag the result is the same.  A null text has size 0 and takes 0;
    a null source is a source; an empty table gives no rows; other columns are ignored.
    """
    return _drawn(docs, False, weights, share, most, shards, block_docs, seed).select("doc_id", "size", "source", "source_size", "target", "taken", "draws")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, block_docs: int = 256, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns, a row for each time they are drawn; one drawn in part stays if
    at least half of it is.  Rows of one shard lie together in shuffled order."""
    rows = _drawn(docs, True, weights, share, most, shards, block_docs, seed)
    out = rows.select("row", "size", F.explode("draws").alias("d")).where(2 * F.col("d.words") >= F.col("size")).select("row", "d.shard", "d.place")
    return out.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")

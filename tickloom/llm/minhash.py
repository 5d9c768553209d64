"""Near-duplicate classes by b-bit MinHash, banded candidates and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import U64, mix64, shingle_sets, text_slices, written
from .graph import components

BANDS, ROWS, BITS = 40, 5, 4
HASHES = BANDS * ROWS
LANES = 64 // BITS
WORDS = -(-HASHES // LANES)

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[None, :]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The HASHES minima of a set of 64-bit shingle hashes."""
    x = (shingles >> U64(32)).astype(np.uint32)[:, None]
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512] * _A + _B).min(axis=0), out=low)
    return low


def packed(minima_rows: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, LANES to a signed 64-bit word: (rows, WORDS)."""
    low = np.zeros((len(minima_rows), WORDS * LANES), U64)
    low[:, :HASHES] = minima_rows & np.uint32((1 << BITS) - 1)
    lanes = low.reshape(len(minima_rows), WORDS, LANES) << (np.arange(LANES, dtype=U64) * U64(BITS))
    return np.bitwise_or.reduce(lanes, axis=2).astype(np.int64)


def band_keys(minima_rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS minima: (rows, BANDS)."""
    m = minima_rows.reshape(len(minima_rows), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), m.shape[:2])
    for r in range(ROWS):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.astype(np.int64)


def _signature_batches(k: int, sign: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in text_slices(batch.column(1)):
                sets = shingle_sets(data, off, k)
                ids = batch.column(0).slice(row, len(sets))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                if not sign:
                    flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([ids, *_marks(sets), lists], ["doc_id", "f0", "f1", "shingles"])
                    continue
                low = np.stack([minima(s) for s in sets])
                words = packed(low)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), pa.int32()), pa.array(band_keys(low).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), *_marks(sets), *(pa.array(words[:, i]) for i in range(WORDS)), bands],
                    ["doc_id", "n", "f0", "f1", *(f"s{i}" for i in range(WORDS)), "bands"],
                )

    return run


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two independent 64-bit fingerprints of each set."""
    one = np.array([s.sum(dtype=U64) if len(s) else 0 for s in sets], U64)
    two = np.array([mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) if len(s) else 0 for s in sets], U64)
    return [pa.array(mix64(x).astype(np.int64)) for x in (one, two)]


SIGNED = "doc_id long, n long, f0 long, f1 long, " + ", ".join(f"s{i} long" for i in range(WORDS)) + ", bands array<long>"


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row per document: set size, set fingerprint, packed b-bit signature, band keys."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signature_batches(k, True), SIGNED)


def shingles(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row per document: set fingerprint and the sorted set of 64-bit shingle hashes."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signature_batches(k, False), "doc_id long, f0 long, f1 long, shingles array<long>")


def similarity(left: str, right: str) -> Column:
    """Estimated Jaccard similarity from the differing lanes, corrected for chance agreement of BITS bits."""
    ones = sum(1 << (BITS * i) for i in range(LANES))
    ones -= (ones >> 63) << 64

    def differ(i: int) -> Column:
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        spread = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftrightunsigned(x, j) for j in range(1, BITS)], x)
        return F.bit_count(spread.bitwiseAND(F.lit(ones)))

    agree = 1 - sum((differ(i) for i in range(WORDS)), F.lit(0)) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Written sets (rep, set) of the documents named in ids(rep); both sides grow, so neither is broadcast."""
    named = ids.select(F.col("rep").alias("doc_id")).distinct()
    met = docs.hint("merge").join(named, "doc_id", "left_semi")
    return written(shingles(met, k).where("size(shingles) > 0").select(F.col("doc_id").alias("rep"), F.col("shingles").alias("set")).distinct(), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets have 100 * intersection >= threshold * union."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")), k)
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.hint("merge").join(right, "b").hint("merge").join(left, "a")
    return met.where(100 * both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _linked_blocks(threshold: int, columns: int = 4096):
    """A kernel over one block of candidates against one block of a unit: exact intersections of all pairs, as
    products of 0/1 matrices over the shingles that both blocks have; emits one link per row and component."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        rep, comp = np.asarray(table.column("rep")), np.asarray(table.column("comp"))
        sets = table.column("set").combine_chunks()
        values, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        owner = np.repeat(np.arange(len(rep)), np.diff(ends))
        sizes = np.diff(ends)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.empty(len(rep), np.int64)
        place[x], place[y] = np.arange(len(x)), np.arange(len(y))
        of_x = side[owner] == 0
        shared = np.intersect1d(values[of_x], values[~of_x])
        keep = np.isin(values, shared)
        column = np.searchsorted(shared, values[keep])
        row, in_x = owner[keep], of_x[keep]
        both = np.zeros((len(x), len(y)), np.float32)
        for c in range(0, len(shared), columns):
            mine = (column >= c) & (column < c + columns)
            mx, my = np.zeros((len(x), columns), np.float32), np.zeros((len(y), columns), np.float32)
            mx[place[row[mine & in_x]], column[mine & in_x] - c] = 1
            my[place[row[mine & ~in_x]], column[mine & ~in_x] - c] = 1
            both += mx @ my.T
        both = both.astype(np.int64)
        i, j = np.nonzero(100 * both >= threshold * (sizes[x][:, None] + sizes[y][None, :] - both))
        i, j = x[i], y[j]
        i, j = i[comp[i] != comp[j]], j[comp[i] != comp[j]]
        _, first = np.unique(np.stack([rep[i], comp[j]], axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        return pa.table({"a": pa.array(rep[i[first]]), "b": pa.array(rep[j[first]])})

    return run


#: Members of a bucket from which its open pairs are compared by blocks of BLOCK sets; below it pair by pair.
#: The rows of one crowd are dealt to SALTS parts where they meet what is known of the crowd as a whole.
CROWD, BLOCK, SALTS = 64, 256, 32


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, slack: float = 0.14) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least threshold percent.

    docs: doc_id, text (other columns are ignored, whatever they are called).  Shingles are k
    consecutive words of the ASCII-lower-cased text; a shorter text is one shingle; a null or blank
    text has the empty set, which is linked with nothing.  Returns doc_id, n_shingles, component_id
    (the smallest doc_id reachable), kept (doc_id = component_id; false for a null doc_id).  Rows that
    repeat a doc_id stay rows, each with the component of its own text.

    1. Equal sets collapse to their smallest doc_id, so copies cost a row each and no pairs.
    2. Sets that share a band are candidates.  Each is compared with the smallest member of a bucket
       that looks surely alike and with the most alike one, estimated from the packed low bits (slack:
       how far below the threshold an estimate may be: 4.8 of its standard errors of 0.029, so one linked
       pair in a million looks unlike) and confirmed on
       full sets; this joins nearly all of a group of near copies into one component.
    3. Buckets whose members still are in several components: pair by pair, estimated and confirmed,
       or, in a bucket of CROWD members or more, every member outside the component that has most of
       them against that component and the other such members, in blocks that emit confirmed links only.
    Pairs inside a component can't change the result, so no link between different texts is lost.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(docs, k), "signed")
    mark = ["f0", "f1"]
    reps = signed.where("n > 0 and doc_id is not null").groupBy(*mark).agg(F.min("doc_id").alias("rep"))
    lanes = [f"s{i}" for i in range(WORDS)]
    met = signed.join(reps.withColumn("doc_id", F.col("rep")), ["doc_id", *mark], "left_semi").dropDuplicates(["doc_id", *mark])
    sets = written(met.select(F.col("doc_id").alias("rep"), "n", *lanes, "bands"), "sets-signed")
    light = sets.select("rep", F.struct("n", *lanes).alias("x"))
    floor = threshold / 100 - slack

    def alike(x: str, y: str) -> Column:
        """What any linked pair passes: the bound from the set sizes, and the estimate."""
        small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
        return (100 * small >= threshold * large) & (similarity(x, y) >= floor)

    exploded = sets.select("rep", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("rep").alias("p"), F.count("*").alias("members")).where("members > 1")
    inside = written(exploded.hint("merge").join(buckets, "band"), "buckets")
    starred = inside.where("rep <> p").select("rep", "p").distinct()
    stars = starred.join(light, "rep").join(light.select(F.col("rep").alias("p"), F.col("x").alias("y")), "p").where(alike("x", "y"))
    stars = stars.select("rep", "p", similarity("x", "y").alias("est"))
    by_hub = Window.partitionBy("rep").orderBy((F.col("est") >= threshold / 100).desc(), "p")
    by_est = Window.partitionBy("rep").orderBy(F.col("est").desc(), "p")
    first = stars.withColumns({"i": F.row_number().over(by_hub), "j": F.row_number().over(by_est)}).where("i = 1 or j = 1")
    first = written(first.select(F.col("rep").alias("a"), F.col("p").alias("b")).distinct(), "stars")
    links = written(_confirmed(first, docs, k, threshold), "links-stars")
    label = written(components(links), "components-1")

    named = label.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    placed = inside.select("rep", "band", "members").join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("there"))
    largest = F.max(F.struct("there", "comp")).alias("main")
    mixed = parts.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), largest).where("lo <> hi").select("band", F.col("main.comp").alias("main"))
    open_rows = written(placed.join(mixed, "band"), "open-buckets")

    crowd = open_rows.where(F.col("members") >= CROWD)
    units = written(crowd.where("comp <> main").select("main", "rep", "comp").distinct(), "units")
    salt, salts = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    mains = units.groupBy("main").agg(F.count("*").alias("outside"))  # a crowd has CROWD members or more, so this times SALTS is less than the rows
    core = placed.select("rep", "comp").distinct().select("*", salt).hint("merge").join(mains.select(F.col("main").alias("comp"), "outside", salts), ["comp", "salt"])
    every = core.select(F.col("comp").alias("main"), "rep", "comp").unionByName(units)
    counts = every.groupBy("main").agg(F.count("*").alias("all")).hint("merge").join(mains, "main").select("*", salts)
    chunk = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / BLOCK))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1))
    counted = lambda x: x.select("*", salt).hint("merge").join(counts, ["main", "salt"])
    xs = counted(units).select("main", "rep", "comp", F.lit(0).alias("side"), chunk("outside").alias("i"), others("all").alias("j"))
    ys = counted(every).select("main", "rep", "comp", F.lit(1).alias("side"), others("outside").alias("i"), chunk("all").alias("j"))
    blocks = written(xs.unionByName(ys), "blocks")
    crowd_sets = _sets(docs, blocks.select("rep"), k)
    found = blocks.hint("merge").join(crowd_sets, "rep").groupBy("main", "i", "j").applyInArrow(_linked_blocks(threshold), "a long, b long")
    crowd_links = written(found, "links-crowds")

    home = every.groupBy("rep").agg(F.max("main").alias("home"))
    few = open_rows.where(F.col("members") < CROWD).join(home, "rep", "left").join(light, "rep")
    left = few.select("band", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("home").alias("ha"), "x")
    right = few.select("band", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("home").alias("hb"), F.col("x").alias("y"))
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~F.coalesce(F.col("ha") == F.col("hb"), F.lit(False))
    across = left.join(right, (left.band == right.band) & apart & alike("x", "y")).select("a", "b").distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(across.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = crowd_links.unionByName(_confirmed(rest, docs, k, threshold))
    known = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = components(known.unionByName(more))

    named = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*mark, F.coalesce("component", "rep").alias("component"))
    out = signed.where("n > 0").join(named, mark, "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each class, with all its columns: the smallest doc_id.  Of rows that repeat a kept doc_id the one
    with the least text stays; rows without a doc_id can't be told apart and stay."""
    kept = near_duplicates(docs, k, threshold).where("kept").select("doc_id").distinct()
    place = "_place_" + "_".join(docs.columns)
    one = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1).drop(place)
    return one.unionByName(docs.where("doc_id is null"))

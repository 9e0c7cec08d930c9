"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, dropped, pick, shared_dir, utf8, written
from .blocks import pack, unpack
from .files import put, whole
from .graph import components
from .lexicon import by_block, give_back, parts_of
from .repeats import LOW, by_part, slices

BITS = 64


def _majority(hashes: np.ndarray) -> int:
    """The word whose bit is 1 where over half of hashes have it."""
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255  # 255 rows add up within a byte
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles: A-Z lower-cased, repeats counted, XXH64. No words: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(whole[s:e], seed) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return _majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long. Null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _tables(radius: int, segments: int, joint: int) -> list[tuple[list[int], int]]:
    """(bit positions of the key, flips that any pair within radius has there in one table at most)."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    flips = radius * joint // segments
    return [([b for s in pick_ for b in range(edges[s], edges[s + 1])], flips) for pick_ in combinations(range(segments), joint)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(fps: DataFrame, radius: int = 2, segments: int = 3, joint: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) at most radius bits apart.

    Multi-index hashing. A table is kept for each choice of `joint` of the `segments`. A pair within
    radius has, in the choice it differs least in, at most floor(radius * joint / segments) flips; so
    each fingerprint is looked up under every key in a ball of that many flips, and what a table
    returns is held against the complete distance. Balls are enumerated from 0 to 1 only: of two keys
    one flip apart, the one with the zero finds the other. Two segments in a key (43 bits) keep the
    buckets small also where thousands of near copies share a segment. Fingerprints are distinct
    before the tables are made, so a pair's number of partners is bounded by the ball, not by copies.
    """
    tables = _tables(radius, segments, joint)
    if any(f > 1 for _, f in tables):
        raise ValueError("choose more segments: balls of over one flip are not enumerated")
    keys, probes = [], []
    for t, (bits, flips) in enumerate(tables):
        mask = sum(1 << b for b in bits)
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
        near = F.array(key)
        if flips:
            ones = F.array(*[F.lit(_signed(1 << b)) for b in bits])
            near = F.concat(near, F.transform(F.filter(ones, lambda o: F.col("fp").bitwiseAND(o) == 0), lambda o: key.bitwiseOR(o)))  # noqa: B023
        probes.append(F.transform(near, lambda k: F.struct(F.lit(t).alias("t"), k.alias("key"))))  # noqa: B023
    held = fps.select(F.col("fp").alias("x"), F.explode(F.array(*keys)).alias("k")).select("x", "k.t", "k.key")
    asked = fps.select(F.col("fp").alias("y"), F.explode(F.concat(*probes)).alias("k")).select("y", "k.t", "k.key")
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius) & (F.col("x") != F.col("y"))
    found = asked.join(held, (asked.t == held.t) & (asked.key == held.key) & near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id, n_links): every document with the smallest doc_id it is linked to.

    Documents link when their fingerprints differ in at most radius bits; component_id is the smallest
    doc_id reachable over links, the document itself included. n_links counts the links of the
    document's fingerprint to other fingerprints; documents of one fingerprint are one class and are
    not expanded into pairs. Null text: as empty, fingerprint 0. Null doc_id: linked like any other,
    never a component_id unless all of the component are null. Repeated rows stay rows. No documents:
    no rows.
    """
    each = written(fingerprints(docs, words, seed))
    classes = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = written(hamming_links(classes.select("fp"), radius))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(links)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return each.join(named, "fp").select("doc_id", "fp", "component_id", "n_links")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted: as fingerprint() takes them. No words: none."""
    parts = text.lower().split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)] if parts else [], np.uint64).view(np.int64)
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    found = [digest(whole[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, block_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, component_id): near copies by the Jaccard similarity of their `words`-word shingles, with
    the smallest doc_id of their group. Every pair of `similarity` or more is linked, and no other.

    Multi-index hashing finds the fingerprints at most `radius` bits apart, and their shingle sets are
    then compared whole. Sets as far apart as `similarity` allows differ in a sixth of all bits, and no
    balls of a few flips reach there; so for the rest sets meet at shingles. How many texts have a
    shingle is counted over all of them. A text with more shingles of its own than `similarity` leaves
    open is near no other and takes no further part, fingerprints included. The others meet at the
    first n - ceil(similarity * n) + 1 of their shingles, the rarest first; two that similar share one
    of those. Sets that meet are first held against the hub of their shingle, the one whose own shingles
    most texts have; then only pairs whose ends are in two groups are left to compare. So a large
    group costs no pairs, its hub has them all. Of those pairs, the Hamming distance of 1024-bit parity sketches, which no two sets
    exceed the difference of, leaves few. Equal sets are one class (64-bit digest) and cost no pairs.

    Null and empty texts have no shingles and link with nothing; a text of fewer words is one shingle.
    Null doc_id: linked like any other, never a component_id unless all of the group are null. Repeated
    rows stay rows. A text of more than block_bytes is a block of its own. No documents: no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    parts = parts_of(docs)

    def keyed(flat: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each shingle as a by_part() key; the distinct ones in order, and how many classes of the block have them."""
        keys, once = by_part(flat.view(np.uint64), parts), np.zeros(len(fps), bool)
        once[np.unique(fps, return_index=True)[1]] = True
        return keys, *np.unique(keys[np.repeat(once, sizes)], return_counts=True)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in cut([batch], "text", block_bytes):
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                sets = [shingle_set(t, words) for t in utf8(part.column(1))]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
                marks = np.array([_majority(x.view(np.uint64)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                sizes, flat = np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)
                made = pack(ids, null, fps, marks, sizes, flat)
                digest = xxhash.xxh64_intdigest(made) >> 1
                put(folder, f"{block:016x}-{digest:016x}.sets", [made])
                _, keys, counts = keyed(flat, sizes, fps)
                sent = [(p, pack((keys[a:b] & LOW).astype(np.uint32), np.minimum(counts[a:b], 255).astype(np.uint8))) for p, a, b in slices(keys)]
                sent = sent or [(0, pack(np.zeros(0, np.uint32), np.zeros(0, np.uint8)))]
                n = len(sent)
                out = pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in sent], pa.int32()), "block": pa.array([block] * n, pa.int64()), "digest": pa.array([digest] * n, pa.int64()), "pack": pa.array([x for _, x in sent], pa.binary())})
                del sets, flat, made, keys, counts, sent
                give_back()
                yield out
                block += 1

    def count(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        got = [unpack(x) for x in rows["pack"].to_pylist()]
        _, which = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.minimum(np.bincount(which, np.concatenate([g[1] for g in got])), 255).astype(np.uint8)
        ends = np.cumsum([len(g[0]) for g in got]).tolist()
        return pa.table({**{c: rows[c] for c in ("part", "block", "digest")}, "pack": pa.array([pack(total[which[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    def finish(key: tuple[pa.Scalar, ...], told: pa.Table) -> pa.Table:
        ids, null, fps, marks, sizes, flat = unpack(whole(folder, f"{key[0].as_py():016x}-{key[1].as_py():016x}.sets"))
        keys, ranked, _ = keyed(flat, sizes, fps)
        counts = np.concatenate([unpack(x)[0] for _, x in sorted(zip(told["part"].to_pylist(), told["pack"].to_pylist(), strict=True))])
        often = counts[np.searchsorted(ranked, keys)] if len(keys) else counts
        ends = np.cumsum(sizes)
        spare = (sizes - np.ceil(similarity * sizes - 1e-9)).astype(np.int64)
        own = np.diff(np.concatenate([[0], np.cumsum(often == 1)])[np.concatenate([[0], ends])])
        met, sets, odds = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        for i in np.flatnonzero((own <= spare) & (sizes > 0)).tolist():
            a, b = int(ends[i] - sizes[i]), int(ends[i])
            first = a + np.lexsort((flat[a:b], often[a:b]))[: spare[i] + 1]
            met[i], sets[i] = flat[first[often[first] > 1]], flat[a:b]
            odds[i] = np.packbits(np.bincount(flat[a:b] & 1023, minlength=1024) & 1).view(np.int64)
        shared = np.diff(np.concatenate([[0], np.cumsum(often, dtype=np.int64)])[np.concatenate([[0], ends])]) * 1000 // np.maximum(sizes, 1)
        made = pa.table({"doc_id": pa.array(ids, mask=null), "fp": pa.array(fps), "mark": pa.array(marks), "n": pa.array(sizes, pa.int32()), "own": pa.array(own, pa.int32()), "often": pa.array(shared, pa.int32()), "ks": pa.array(met, pa.list_(pa.int64())), "sh": pa.array(sets, pa.list_(pa.int64())), "odd": pa.array(odds, pa.list_(pa.int64()))})
        give_back()
        return made

    sent = pick(docs, "doc_id", "text").mapInArrow(tell, "part int, block long, digest long, pack binary")
    counted = sent.groupBy("part").applyInArrow(count, "part int, block long, digest long, pack binary")
    each = written(by_block(counted, parts).applyInArrow(finish, "doc_id long, fp long, mark long, n int, own int, often int, ks array<bigint>, sh array<bigint>, odd array<bigint>"))
    dropped(spark, folder)
    held = written(each.where("ks is not null").select("fp", "mark", F.struct("n", "own").alias("size"), "often", "ks", "sh", "odd").dropDuplicates(["fp"]))

    # Of two sets that similar, what one has and the other lacks is at most this share of both sizes; shingles of its own a set has alone.
    apart = (1 - similarity) / (1 + similarity)
    possible = (F.least("sa.n", "sb.n") >= similarity * F.greatest("sa.n", "sb.n") - 1e-9) & (F.col("sa.own") + F.col("sb.own") <= apart * (F.col("sa.n") + F.col("sb.n")) + 1e-9)

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, sa, sb) those that are similar."""
        pairs = pairs.where(possible & (F.col("a") != F.col("b")))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(held.select(F.col("fp").alias("a"), F.col("sh").alias("x")), "a").join(held.select(F.col("fp").alias("b"), F.col("sh").alias("y")), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("s"))
        return written(shared.where(F.col("o") >= similarity * (F.col("s") - F.col("o")) - 1e-9).select("a", "b"))

    # Of equal fingerprints the smallest class stands for all, and each of them is held against it.
    marked = written(held.groupBy("mark").agg(F.min(F.struct("fp", "size")).alias("one")))
    close = hamming_links(marked.select(F.col("mark").alias("fp")), radius, 4, 2)
    one = lambda c: marked.select(F.col("mark").alias(c), F.col("one").alias(f"{c}1"))
    close = close.join(one("a"), "a").join(one("b"), "b").select("a1.fp", "b1.fp", "a1.size", "b1.size").toDF("a", "b", "sa", "sb")
    equal = held.select("fp", "mark", "size").join(marked, "mark").select("fp", "one.fp", "size", "one.size").toDF("a", "b", "sa", "sb")
    keys = held.select(F.explode("ks").alias("k"), "fp", "size", "often")
    rank = F.struct("often", "fp")
    several = keys.groupBy("k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max_by(F.struct("fp", "size"), rank).alias("hub")).where("lo < hi")
    met = written(keys.join(several, "k").select("k", "fp", "size", "hub"))
    stars = met.select("fp", "hub.fp", "size", "hub.size").toDF("a", "b", "sa", "sb")
    links = linked(close.union(equal).union(stars))
    roots = written(components(links))
    rooted = written(met.join(roots, met.fp == roots.node, "left").select("k", "fp", "size", F.coalesce("root", "fp").alias("root")))
    open_ = rooted.groupBy("k").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("k")
    met = rooted.join(open_, "k", "left_semi")
    # Bits that tell of 1024 parts of all shingles whether a set has an odd number: where two sets' bits differ, they differ in a shingle at least.
    left = written(met.join(held.select("fp", "odd"), "fp").select("k", "fp", "size", "root", "odd"))
    x, y = left.toDF("k", "a", "sa", "ra", "oa"), left.toDF("k2", "b", "sb", "rb", "ob")
    differ = F.expr(" + ".join(f"bit_count(oa[{i}] ^ ob[{i}])" for i in range(16)))
    fit = possible & (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & (differ <= apart * (F.col("sa.n") + F.col("sb.n")) + 1e-9)
    rest = linked(x.join(y, (F.col("k") == F.col("k2")) & fit).select("a", "b", "sa", "sb"))
    if not rest.isEmpty():
        roots = components(links.union(rest))
    classes = each.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = written(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    found = each.where("n > 0").select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")
    return found.union(each.where("n = 0").select("doc_id", F.col("doc_id").alias("component_id")))


def op4_simhash_near_dedup(spark, sf_dir):
    """Contract query of operator 4 over all of documents."""
    from ._common import table

    found = simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")

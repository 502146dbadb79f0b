"""Near-duplicate detection by min-max hashing.

For every permutation both the smallest and the largest hash of a document's word
shingles are kept, so a signature of given length needs half the hash evaluations;
minima and maxima both agree with probability equal to the Jaccard similarity.  Bands
of two permutations (two minima and two maxima) choose candidates.  Candidates pass an
exact bound first: the parity sketches of two sets differ in at most as many bits as
the sets differ in elements, so pairs whose sketches differ more cannot be linked.  The
rest are confirmed on their full shingle sets.

Documents with equal sets form one class and only its representative is banded.  In
each bucket all members are first compared with its smallest one; components of the
confirmed links follow; then, in buckets whose members are not of one component yet,
every pair across components is tested, in blocks of bounded size.  No pair within a
component is looked at, nothing is capped or sampled, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.graph import connected_components
from logweave.llm.small_side import bounded_batches, join_checked
from logweave.llm.suffix_dedup import text_version
from logweave.plans.scratch import written

#: A pair at the least similarity 0.8 misses all bands with probability (1 - 0.8**4)**20, about 3 in 100,000.
BANDS = 20
#: Members of a bucket that meet in one task, from each of two blocks.
BLOCK = 1024
_BITS = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)
_FEATURES = "struct<n_shingles:bigint,d1:bigint,d2:bigint,bands:array<bigint>,sketch:binary>"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (48-bit hashes, sorted) of each of up to 65,536 rows, tagged with the row in the top bits; heads.

    A row that stands alone, as every long one does, keeps 64-bit hashes.
    """
    w = tk.Words(buf, offsets)
    values, heads = tk.shingles(w, k)
    if len(offsets) == 2:
        values = np.unique(values)
        return values, np.array([0, len(values)])
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(heads))
    tagged = np.sort((rows << _BITS) | (values >> np.uint64(16)))
    if len(tagged):
        tagged = tagged[np.concatenate([[True], tagged[1:] != tagged[:-1]])]
    return tagged, np.searchsorted(tagged >> _BITS, np.arange(len(offsets), dtype=np.uint64))


def _pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    for a, b in tk.chunks(offsets, size):
        for c in range(a, b, 65_536):
            yield c, min(b, c + 65_536)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of a set of n: a power of two, 2n to 4n, from 256 to 65,536."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 256, 65_536)


def _features(texts: pa.Array, k: int, bands: int) -> pa.StructArray:
    buf, offsets = tk.utf8(texts)
    total = len(offsets) - 1
    n_all = np.zeros(total, np.int64)
    digests = np.zeros((2, total), np.uint64)
    keys = np.zeros((total, bands), np.uint64)
    sketches: list[bytes] = [b""] * total
    seeds = tk.mix(np.arange(1, 4 * bands + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    for a, b in _pieces(offsets, 1 << 20):
        tagged, heads = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
        n = np.diff(heads)
        n_all[a:b] = n
        full = np.flatnonzero(n)
        if not len(full):
            continue
        at, x = heads[full], tagged >> np.uint64(16) if b - a == 1 else tagged & _MASK
        h = tk.mix(x)
        digests[0, a + full] = np.add.reduceat(h, at)
        digests[1, a + full] = np.add.reduceat(tk.mix(x ^ np.uint64(0x5BD1E995A1B2)), at)
        low = (h >> np.uint64(32)).astype(np.uint32)
        for band in range(bands):
            key = np.full(len(full), band + 1, np.uint64)
            for p in (2 * band, 2 * band + 1):
                y = low * seeds[2 * p]
                y ^= y >> np.uint32(15)
                y *= seeds[2 * p + 1]
                y ^= y >> np.uint32(13)
                for v in (np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)):
                    key = tk.mix(key ^ v.astype(np.uint64))
            keys[a + full, band] = key
        bits = sketch_bits(n[full])
        base = np.concatenate([[0], np.cumsum(bits)])
        where = np.repeat(base[:-1], n[full]) + (x & np.repeat(bits - 1, n[full]).astype(np.uint64)).astype(np.int64)
        parity = np.packbits((np.bincount(where, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
        for r, lo, hi in zip(full.tolist(), (base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True):
            sketches[a + r] = parity[lo:hi]
    filled = n_all > 0
    ends = np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[filled].reshape(-1).view(np.int64)))
    return pa.StructArray.from_arrays(
        [pa.array(n_all), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), listed, pa.array(sketches, pa.binary())],
        names=["n_shingles", "d1", "d2", "bands", "sketch"],
    )


def signature(text: Column, k: int, bands: int = BANDS) -> Column:
    """Set size, 128-bit set digest, band keys and parity sketch of a text column; null is empty."""

    @F.arrow_udf(_FEATURES)
    @tk.trimmed
    def features(texts: pa.Array) -> pa.Array:
        return _features(texts, k, bands)

    return features(text)


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two parity sketches differ, the longer one folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _may_link(num: int, den: int):
    @F.arrow_udf("boolean")
    @tk.trimmed
    def test(na: pa.Array, nb: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        s = (na.to_numpy() + nb.to_numpy()) * (den - num)
        return pa.array([sketch_distance(a.as_py(), b.as_py()) * (den + num) <= x for a, b, x in zip(sa, sb, s.tolist(), strict=True)], pa.bool_())

    return test


def _linked(k: int, num: int, den: int):
    """Whether den * |A and B| >= num * |A or B| for the full shingle sets of two texts."""

    @F.arrow_udf("boolean")
    @tk.trimmed
    def test(ta: pa.Array, tb: pa.Array) -> pa.Array:
        (ba, oa), (bb, ob) = tk.utf8(ta), tk.utf8(tb)
        out = np.zeros(len(ta), bool)
        for a, b in _pieces(oa + ob, 4 << 20):
            x, hx = shingle_sets(ba[oa[a] : oa[b]], oa[a : b + 1] - oa[a], k)
            y, hy = shingle_sets(bb[ob[a] : ob[b]], ob[a : b + 1] - ob[a], k)
            both = np.sort(np.concatenate([x, y]))
            shared = both[:-1][both[1:] == both[:-1]]
            inter = np.bincount((shared >> _BITS).astype(np.int64), minlength=b - a) if b - a > 1 else np.array([len(shared)])
            out[a:b] = den * inter >= num * (np.diff(hx) + np.diff(hy) - inter)
        return pa.array(out)

    return test


def confirm(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts are linked; texts (rep, text) are fetched for the named ones alone."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids")
    held = written(join_checked(texts, named, "rep", "left_semi").dropDuplicates(["rep"]), "texts")
    side = [held.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b")]
    met = pairs.join(side[0], "a").join(side[1], "b")
    return met.where(_linked(k, num, den)("text_a", "text_b")).select("a", "b")


def _sort_key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in which these stand together."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        ks = [t[c].to_numpy() for c in keys]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in ks], axis=0)) + 1
        edges = [0, *cut.tolist(), t.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(k[a]) for k in ks)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)


def _cross_pairs(num: int, den: int):
    """Pairs of a block group that may be linked: of different components, of fitting size, sketches near enough,
    and met in no earlier band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sort_key_groups(batches, ["key", "i", "j"]):
            rep, v, n, comp, comp_v = (t[c].to_numpy() for c in ("rep", "v", "n_shingles", "comp", "comp_v"))
            block, i, j = t["block"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
            key = t["key"][0].as_py()
            sketches = t["sketch"].combine_chunks()
            bands = t["bands"].combine_chunks()
            bands = (bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands).flatten().to_numpy().reshape(len(rep), -1)
            band = int(np.flatnonzero((bands == key).all(axis=0))[0])
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            sk = sketches.to_pylist()
            for a in left.tolist():
                r = right[right > a] if i == j else right
                r = r[((comp[r] != comp[a]) | (comp_v[r] != comp_v[a])) & (den * np.minimum(n[r], n[a]) >= num * np.maximum(n[r], n[a]))]
                if not len(r):
                    continue
                r = r[(bands[r] == bands[a]).argmax(axis=1) == band]
                near = [x for x in r.tolist() if sketch_distance(sk[a], sk[x]) * (den + num) <= (den - num) * int(n[a] + n[x])]
                if near:
                    here = pa.StructArray.from_arrays([pa.array(np.full(len(near), rep[a])), pa.array(np.full(len(near), v[a]))], names=["id", "v"])
                    there = pa.StructArray.from_arrays([pa.array(rep[near]), pa.array(v[near])], names=["id", "v"])
                    yield pa.RecordBatch.from_arrays([here, there], names=["x", "y"])

    return run


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of at least percent / 100.

    docs has doc_id (integer) and text.  Returns doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links) and kept (doc_id = component_id), one row for
    each row of docs.  Null, empty and blank texts have no shingles and are linked with
    nothing.  Rows without a doc_id take no part; their component_id and kept are null.
    Rows that repeat a doc_id are each placed by their own text; links and classes go by id
    and text together, so that no text's links are lost.  Other columns are not read.  The table must give the same rows whenever it is read.
    """
    num, den = percent, 100
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_version(F.col("text")).alias("v"))
    texts = docs.select(F.struct(F.col("doc_id").alias("id"), "v").alias("rep"), "text")
    feats = written(docs.select("doc_id", "v", signature(F.col("text"), k, bands).alias("f")).select("doc_id", "v", "f.*"), "signatures")
    one = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    of_class = ["d1", "d2", "n_shingles"]
    classes = written(one.groupBy(*of_class).agg(F.min(F.struct(F.col("doc_id").alias("id"), "v")).alias("rep"), F.first(F.struct("bands", "sketch")).alias("s")).select(*of_class, "rep", "s.*"), "classes")

    dealt = classes.select("rep", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("m")).where("m > 1")
    multi = written(dealt.join(shared, "key"), "buckets")
    about = classes.select("rep", "n_shingles", "sketch")

    def both_sides(pairs: DataFrame) -> DataFrame:
        a, b = (about.select(*[F.col(c).alias(f"{c}_{x}") for c in about.columns]) for x in ("a", "b"))
        return pairs.join(a, F.col("a") == F.col("rep_a")).join(b, F.col("b") == F.col("rep_b"))

    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    stars = multi.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    stars = both_sides(stars).where(den * small >= num * large)
    stars = stars.where(_may_link(num, den)("n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b")).select("a", "b")
    links = written(confirm(written(stars, "pairs"), texts, k, num, den), "links")

    parts = connected_components(links)
    placed = multi.join(parts, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rep")).select("key", "rep", "m", "comp")
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int")
    rows = (
        placed.join(mixed, "key", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "rep", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(classes.select("rep", "n_shingles", "bands", "sketch"), "rep")
        .select("key", "i", "j", "block", F.col("rep.id").alias("rep"), F.col("rep.v").alias("v"), F.col("comp.id").alias("comp"), F.col("comp.v").alias("comp_v"), "n_shingles", "bands", "sketch")
    )
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    found = rows.mapInArrow(tk.tidy(_cross_pairs(num, den)), "x struct<id:bigint,v:bigint>, y struct<id:bigint,v:bigint>")
    pairs = written(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    more = written(confirm(pairs, texts, k, num, den), "links")
    parts = written(connected_components(links.unionByName(more)), "components")

    known = classes.join(parts, F.col("rep") == F.col("node"), "left").select(*of_class, F.coalesce("root.id", "rep.id").alias("component_id"))
    out = feats.select("doc_id", *of_class).join(known, of_class, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))

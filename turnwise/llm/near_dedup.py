"""Near-duplicate groups: fast similarity sketching, banding, exact verification, distributed components.

1. Each text becomes the set of its 64-bit hashed 5-word shingles, a 128-bit
   fingerprint of that set, and a sketch of T coordinates. The sketch fills in
   rounds: in each of the first T rounds every element falls into one hashed
   bin; bins still empty after them take, in T further rounds, the least hash of
   all elements. So every coordinate is filled, and the share of equal
   coordinates of two sketches is concentrated around the Jaccard similarity.
2. Texts with equal fingerprints become one node; copies go no further.
3. Bands of ROWS coordinates are the bucket keys. In each bucket the smallest
   node leads, and each other node is paired with the leader: the number of
   pairs is linear however large a bucket is.
4. Pairs are verified on the full sets of both texts; components of verified
   links are found by alternating large-star and small-star steps.
5. What is left are bucket mates that are in different components and of which
   neither led. In buckets where more than BLOCK of them are outside the largest component,
   mates are dealt anew to the buckets of each pair of bands. Then sketches are compared across
   components, and components with a pair whose
   estimate reaches ESTIMATE are joined to families; in a family, whose members move once,
   texts of different components are compared on their full sets. Both
   comparisons go by blocks; rows of the largest component meet the others only,
   so what is copied grows with the others, and each returns one row for each union, not for each pair. With 56
   bands of 5, two texts at similarity 0.75 share no band with a probability of
   2.5e-7, and less than two, which such large buckets ask for, with one of 4.8e-6; an estimate of theirs
   falls short of ESTIMATE with one of 3e-7 where no chain of other texts links them.

No step gathers a bucket, a group or a component in one task or on the driver.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_broadcast, cut, sliced, small_batches

SHINGLE = 5
PERCENT = 75
ROWS = 5
BANDS = 56
T = ROWS * BANDS
#: Least share of equal coordinates of a pair that is verified: five standard deviations under 0.75.
ESTIMATE = 0.62
#: Nodes, and shingles, that one comparison block holds.
BLOCK = 2048
BLOCK_SHINGLES = 400_000
#: Words a worker remembers the hashes of.
CACHE_WORDS = 250_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _constant(k: int) -> np.uint64:
    return np.uint64((k * _STEP) & 0xFFFFFFFFFFFFFFFF)


_ODD = [_mix(np.array([_constant(k + 1)]))[0] | np.uint64(1) for k in range(SHINGLE)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes: A-Z lower-cased, words between ASCII white space; fewer words than a shingle are one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < size:
        x = np.array([_constant(n)])
        for k in range(n):
            x = _mix(x + w[k : k + 1] * _ODD[k])
        return x
    x = w[: n - size + 1] * _ODD[0]
    for k in range(1, size):
        x = x + _mix(w[k : n - size + 1 + k]) * _ODD[k]
    return np.unique(_mix(x))


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Fast similarity sketches, a row of ``t`` 16-bit coordinates for each set (zeros for an empty one)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full((len(sets), t), np.uint32(0xFFFFFFFF), np.uint32)
    flat_out = out.reshape(-1)
    todo = np.flatnonzero(sizes)
    elements = np.concatenate([sets[i] for i in todo]) if len(todo) else np.zeros(0, np.uint64)
    owner = np.repeat(todo, sizes[todo])
    empty = np.ones(len(sets) * t, bool)
    for i in range(2 * t):
        if not len(elements):
            break
        h = _mix(elements + _constant(i + 11))
        value = ((h & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.uint32)  # below the mark of an empty bin
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        slot = owner * t + bins
        free = empty[slot]
        slot, value = slot[free], value[free]
        np.minimum.at(flat_out, slot, value)
        empty[slot] = False
        if i < 4 or i % 4 == 0 or i >= t:
            open_ = empty.reshape(-1, t).any(axis=1)[owner]
            elements, owner = elements[open_], owner[open_]
    out[sizes == 0] = 0
    return (_mix(out.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _sketch_rows(batches):
    hashes = WordHashes()
    for b in sliced(batches, 512):
        sets = [shingle_set(x.as_py(), hashes) for x in b.column("text")]
        marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([x.tobytes() for x in sketches(sets)], pa.binary())],
            ["doc_id", "n_shingles", "mark", "sketch"],
        )


def _band_rows(batches):
    for part in sliced(batches, 2048):
        keys = _keys(part.column("sketch").to_pylist())
        ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])


def _linked(batches):
    """Pairs whose full sets reach PERCENT; a text that isn't the one its mark stands for is passed over."""
    hashes, kept = WordHashes(), {}

    def of(node, mark, text):
        if (node, mark) not in kept:
            s = shingle_set(text, hashes)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != mark:
                return None
            while len(kept) >= 64:
                kept.pop(next(iter(kept)))
            kept[node, mark] = s
        return kept[node, mark]

    for b in sliced(batches):
        out = []
        for r in zip(*(b.column(c) for c in ("a", "b", "mark_a", "mark_b", "text_a", "text_b")), strict=True):
            a, c, mark_a, mark_b = (x.as_py() for x in r[:4])
            x, y = of(a, mark_a, r[4].as_py()), of(c, mark_b, r[5].as_py())
            if x is not None and y is not None:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    out.append((a, c))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of node ids whose texts are linked. Texts come from ``docs`` by id; only those of paired nodes move."""
    marks = nodes.select("id", "mark")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut(wanted.join(marks, "id"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(bounded_broadcast(wanted, F.lit(32)), "id")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("mark").alias(f"mark_{c}"), F.col("text").alias(f"text_{c}"))
    return cut(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "mark_a", "mark_b", "text_a", "text_b").mapInArrow(_linked, "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of ``links`` (a, b), by large-star and small-star steps."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state = now
    own = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)


def _sides(key, table):
    """The two blocks of a group, the smaller first; twice the same one where a block meets itself."""
    left = table.filter(pa.compute.equal(table.column("side"), 0))
    if key[1].as_py() == key[2].as_py():
        return left, left
    right = table.filter(pa.compute.equal(table.column("side"), 1))
    return (left, right) if len(left) <= len(right) else (right, left)


def _joined(left, right, near):
    """Unites the components of two blocks: near(i) tells which rows of the right are near row i of the left.

    Only rows that aren't yet united with row i are asked about. Returns one (a, b) per union, so fewer than there are components.
    """
    of_x, of_y = left.column("component").to_numpy(), right.column("component").to_numpy()
    names, codes = np.unique(np.concatenate([of_x, of_y]), return_inverse=True)
    root = np.arange(len(names))
    x, y = codes[: len(of_x)], codes[len(of_x) :]
    out = []
    for i in range(len(x)):
        apart = np.flatnonzero(root[y] != root[x[i]])
        for j in apart[near(i, apart)] if len(apart) else ():
            if root[y[j]] != root[x[i]]:
                out.append(sorted((int(of_x[i]), int(of_y[j]))))
                root[root == root[y[j]]] = root[x[i]]
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def _alike_in_block(key, table):
    """Components of a bucket that have mates with near sketches."""
    left, right = _sides(key, table)
    x, y = (np.frombuffer(b"".join(s.column("sketch").to_pylist()), np.uint16).reshape(-1, T) for s in (left, right))
    return _joined(left, right, lambda i, at: (y[at] == x[i]).sum(axis=1) >= ESTIMATE * T)


def _linked_in_block(key, table):
    """Components of a family that a pair of linked texts joins, by the exact intersections of full sets."""
    left, right = _sides(key, table)
    sets = [[np.frombuffer(z, np.uint64) for z in s.column("shingles").to_pylist()] for s in (left, right)]
    sizes = [np.fromiter(map(len, s), np.int64, len(s)) for s in sets]
    every = np.concatenate([*sets[0], *sets[1]]) if table.num_rows else np.zeros(0, np.uint64)
    names, codes = np.unique(every, return_inverse=True)
    x, y = codes[: sizes[0].sum()], codes[sizes[0].sum() :]
    x_at, y_at = np.concatenate([[0], np.cumsum(sizes[0])]), np.concatenate([[0], np.cumsum(sizes[1])[:-1]])
    mark = np.zeros(len(names), np.int32)

    def near(i, at):
        mine = x[x_at[i] : x_at[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[y], y_at)[at]
        mark[mine] = 0
        return 100 * both >= PERCENT * (sizes[0][i] + sizes[1][at] - both)

    return _joined(left, right, near)


def in_blocks(rows: DataFrame, sizes: DataFrame, group: str, function) -> DataFrame:
    """``function`` on pairs of blocks of each group, (a, b) of each union: every two rows of different components meet in one.

    ``rows``: group, id, component, one binary column; ``sizes``: group, component, w, how many blocks its rows fill. Rows of
    a group's largest component have blocks of their own, which meet the others' blocks but not each other.
    """
    sizes = sizes.groupBy(group).agg(F.max(F.struct("w", F.col("component").alias("c"))).alias("most"), F.sum("w").alias("w"))
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-9)).cast("int")
    sizes = sizes.select(group, F.col("most.c").alias("_most"), blocks(F.col("most.w")).alias("_p"), blocks(F.col("w") - F.col("most.w")).alias("_q"))
    dealt = rows.join(sizes, group).withColumn("_in", F.col("component") == F.col("_most"))
    at = lambda n: F.pmod(F.xxhash64("id", group), F.col(n)).cast("int")
    dealt = dealt.withColumn("_own", F.when(F.col("_in"), at("_p")).otherwise(F.col("_p") + at("_q")))
    first = F.when(F.col("_in"), F.col("_p")).otherwise(F.lit(0))
    spread = dealt.withColumn("_other", F.explode(F.sequence(first, F.col("_p") + F.col("_q") - 1)))
    spread = spread.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")})
    return spread.drop("_most", "_p", "_q", "_in", "_own", "_other").groupBy(group, "i", "j").applyInArrow(function, "a long, b long").distinct()


def _keys(sketches: list[bytes]) -> np.ndarray:
    """The bucket key of each band of each sketch."""
    powers = [_constant(1000 + k) | np.uint64(1) for k in range(ROWS)]
    s = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(s.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * powers[k] + s[:, :, k])
    return key


def _second_keys(batches):
    """Each row of a bucket anew, with the key of the bucket and each later band."""
    for part in sliced(batches, 2048):
        keys, own = _keys(part.column("sketch").to_pylist()), part.column("key").to_numpy().view(np.uint64)
        row, band = np.nonzero((keys == own[:, None]).cumsum(axis=1) - (keys == own[:, None]))  # after the band of the bucket
        second = _mix(own[row] + _mix(keys[row, band] ^ _constant(77)))
        yield pa.RecordBatch.from_arrays([pa.array(second.view(np.int64)), part.column("id").take(pa.array(row)), part.column("component").take(pa.array(row))], ["key", "id", "component"])


def mixed(mates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``mates`` (key, id, component), those in buckets of several components: in buckets of which at most BLOCK are
    outside the largest component, and in the others."""
    sizes = mates.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    others = sizes.groupBy("key").agg((F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    kept = cut(mates.join(others, "key"))
    side = lambda c: kept.where(c).select("key", "id", "component")
    return side(F.col("others") <= BLOCK), side(F.col("others") > BLOCK)


def _set_rows(batches):
    hashes = WordHashes()
    for b in sliced(batches):
        sets = [shingle_set(x.as_py(), hashes).tobytes() for x in b.column("text")]
        same = [hashlib.blake2b(s, digest_size=16).digest() == m for s, m in zip(sets, b.column("mark").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(sets, pa.binary())], ["id", "mark", "shingles"]).filter(pa.array(same))


def residual_links(mates: DataFrame, nodes: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Step 5: links (a, b) between components, of bucket ``mates`` (key, id) of which neither led."""
    sketch = nodes.select("id", "sketch")
    few, many = mixed(mates.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    open_ = few
    if many.limit(1).count():
        second = many.join(sketch, "id").select("key", "id", "component", "sketch").mapInArrow(_second_keys, "key long, id long, component long")
        open_ = few.unionByName(reduce(DataFrame.unionByName, mixed(second)))
    sizes = open_.groupBy("key", "component").agg((F.count(F.lit(1)) / BLOCK).alias("w"))
    alike = cut(in_blocks(open_.join(sketch, "id"), sizes, "key", _alike_in_block))
    family = components(alike).select(F.col("id").alias("component"), F.col("component").alias("family"))
    members = cut(open_.select("id", "component").distinct().join(family, "component").join(nodes.select("id", "mark", "n_shingles"), "id"))
    wanted = bounded_broadcast(members.select("id", "mark"), F.lit(32))
    sets = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").mapInArrow(_set_rows, "id long, mark binary, shingles binary")
    sets = sets.groupBy("id", "mark").agg(F.min("shingles").alias("shingles"))
    rows = members.select("family", "id", "mark", "component").join(sets, ["id", "mark"]).drop("mark")
    sizes = members.groupBy("family", "component").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES).alias("w"))
    return cut(in_blocks(rows, sizes, "family", _linked_in_block))


def same_id_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of each doc_id that comes with several texts. ``rows``: doc_id, mark."""
    several = rows.groupBy("doc_id").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("doc_id")
    each = rows.join(several, "doc_id").join(nodes.select("mark", "id"), "mark").select("doc_id", "id").distinct()
    return each.join(each.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    A text without words has no shingles and is a component of its own. Rows
    that repeat a doc_id are one vertex, linked by any of their texts. A null doc_id takes the component of its text, and is
    kept only where no document with an id is in it. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        return _near_dedup(docs)


def _near_dedup(docs: DataFrame) -> DataFrame:
    rows = cut(docs.mapInArrow(_sketch_rows, "doc_id long, n_shingles long, mark binary, sketch binary"))
    nodes = cut(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n_shingles"))
    )
    bands = nodes.select("id", "sketch").mapInArrow(_band_rows, "key long, id long")
    leaders = cut(bands.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    mates = cut(bands.join(leaders, "key").where("id <> lead").select("key", "id", "lead", "members"))
    pairs = cut(mates.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = verified(pairs, nodes, docs).unionByName(same_id_links(rows.where("n_shingles > 0 and doc_id is not null"), nodes))
    found = cut(components(links))
    late = residual_links(mates.where("members > 2").select("key", "id"), nodes, found, docs)
    if late.limit(1).count():
        found = components(links.unionByName(late))
    named = nodes.select("mark", "id").join(found, "id", "left").select("mark", F.coalesce("component", "id").alias("node"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("mark")).alias("mark")).join(named, "mark", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

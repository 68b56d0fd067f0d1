"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

Two sets are linked if their Jaccard similarity is at least num/den; then they
differ in at most k = (den-num)/(den+num) * (sum of sizes) shingles.  Sizes fall
into bands; in a band the universe of shingles is cut by hash into segments
with thresholds 0 (contents must be equal) or 1 (equal up to one shingle, found
by indexing contents and all one-deletions).  With thresholds t, sum(t+1) = k+1
would do; a quarter more make sure that linked sets agree in many segments that
aren't empty, so that a set which shares fewer signatures than that in a band
is dropped there; a set with too many empty segments indexes those as well and
is kept for one shared signature.  The mix of thresholds minimises signatures plus expected chance agreements.

Documents with equal sets form a class, and one of each class goes on.
Signatures meet at hash owners (exchange.py), and only those that two classes
share become rows.  A bucket of classes with one signature isn't expanded into
pairs: every class is verified exactly against the most central class that it
shares one with, links join components, and a bucket whose classes are in one
component is done.  A class
with fewer signatures in other buckets than a linked set shares is done too, and
of the rest all but a few of the commonest signatures are passed over.  Classes
that what is left connects are compared group by group in blocks of bounded size,
where a matrix product gives all intersections at once and one link for each
two components is kept.  No link between different sets is missed.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import shared
from . import textcore as C

#: Ratio of a band's largest to smallest size at least; assumed chance that a shingle of one set is in another one that has chance agreements; weight of such an agreement against a signature.
BAND, CHANCE, WEIGHT = 1.4, 0.3, 5.0
#: Rows of (class, component) that are broadcast at most (32 bytes each).
BROADCAST_ROWS = 100_000
#: Links that one task joins at most.
SMALL_LINKS = 200_000
#: Rows that a round of passing over signatures must leave at most, as a share of those before, for another one to follow.
LESS = 0.95
#: Classes in a block, on average.
BLOCK = 256
#: Buckets for each file of a table that has a few bytes for each document.
BUCKETS_PER_FILE = 16

_U = np.uint64


@cache
def bands(num: int, den: int) -> list[tuple[int, int, int, int, int, int]]:
    """(smallest size, largest size, k, segments of threshold 0, of threshold 1, spare) of every band."""
    out, lo, ratio = [], 1, max(BAND, 1.05 * den / num)
    while lo < 1 << 31:
        hi = max(lo, int(lo * ratio))
        k = (den - num) * 2 * hi // (den + num)
        out.append((lo, hi, k, *allocate(k, 0.85 * hi)))
        lo = hi + 1
    return out


def allocate(k: int, size: float) -> tuple[int, int, int]:
    """The cheapest numbers of segments with threshold 0 and 1, and the spare, for sets of that size."""
    spare = 1 + (k + 1) // 4
    best = None
    for one in {0, 1, 2, (k + 1) // 4, (k + 1 + spare) // 2}:
        zero = k + 1 + spare - 2 * one
        if zero < 0 or not zero + one:
            continue
        per = size / (zero + one)
        cost = zero + one * (1 + per) + WEIGHT * (zero * CHANCE**per + one * (1 + per) * CHANCE ** max(0.0, per - 1))
        best = min(best or (cost, zero, one), (cost, zero, one))
    return best[1], best[2], spare


def signatures(h: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """Distinct signatures of one set of shingle hashes in each of its bands, and how many of them a linked set of that band shares at least."""
    out = []
    table = bands(num, den)
    own = next(i for i, b in enumerate(table) if b[0] <= len(h) <= b[1])
    for band in [own] + ([own + 1] if len(h) * den // num > table[own][1] else []):
        _, _, k, zero, one, spare = table[band]
        if not k:
            continue
        m = zero + one
        value = C.mix(h + _U(0x51ED270B9F652295 * (band + 1) % (1 << 64)))
        seg = ((value >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        value = C.mix(value)
        sums = np.zeros(m, _U)
        np.add.at(sums, seg, value)
        count = np.bincount(seg, minlength=m)
        salt = C.mix(np.arange(m, dtype=_U) + _U(band + 1 << 40))
        full, keep = C.mix(sums ^ salt), count > 0
        # agreement through empty contents: threshold plus one for empty segments, one for a single shingle to delete
        weak = int((count[:zero] == 0).sum() + 2 * (count[zero:] == 0).sum() + (count[zero:] == 1).sum())
        if weak > spare:
            keep[:] = True
        found, need = full[keep], max(1, spare + 1 - weak)
        if one:
            at = seg >= zero
            at &= (count[seg] > 1) | (weak > spare)
            found = np.concatenate([found, C.mix((sums[seg[at]] - value[at]) ^ salt[seg[at]])])
            need = -(-need // 2)  # a segment with threshold 1 stands for two
        out.append((np.unique(found), need if weak <= spare else 1))
    return out


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of every text; of all words, if there are fewer."""
    w = C.words(texts, lower=True)
    h, short = C.window_hashes(w.hash, n), {k: C.window_hashes(w.hash, k) for k in range(1, n)}
    out = []
    for a, z in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True):
        out.append(np.unique(h[a : z - n + 1]) if z - a >= n else short[z - a][a : a + 1] if z > a else h[:0])
    return out


def _class(h: np.ndarray) -> bytes:
    """128-bit name of a set."""
    size = _U(len(h))
    return np.array([(C.mix(h + _U(0x9E37)) + size).sum(dtype=_U), C.mix(h ^ _U(0xC0FFEE123456789)).sum(dtype=_U)], _U).tobytes()


def _classes_and_sets(texts, n: int, wanted: set[bytes]) -> dict[bytes, np.ndarray]:
    found: dict[bytes, np.ndarray] = {}
    for h in shingle_sets(texts, n):
        c = _class(h)
        if c in wanted:
            found.setdefault(c, h)
    return dict(sorted(found.items()))


def _all_signatures(found: dict[bytes, np.ndarray], num: int, den: int):
    each = [signatures(h, num, den) for h in found.values()]
    return each, np.concatenate([np.zeros(0, _U), *(sigs for bands_ in each for sigs, _ in bands_)])


def _gathered(df: DataFrame, buckets: int) -> DataFrame:
    """The same few rows in few partitions, so that few files are written: where files are local, each has the executor start processes that set its mode."""
    return df.repartition(-(-buckets // BUCKETS_PER_FILE))


def classes(docs: DataFrame, id_col: str, text_col: str, n: int):
    """(bucketed rows, number of buckets, table of b, id, n_shingles, c)."""
    rows, buckets = X.bucketed(docs, id_col, text_col)

    def name(table):
        sets = shingle_sets(table.column("text"), n)
        return pa.table({"b": table.column("b"), "id": table.column("id"), "n_shingles": pa.array([len(h) for h in sets], pa.int64()), "c": pa.array([_class(h) for h in sets], pa.binary())})

    schema = T.StructType([T.StructField("b", T.IntegerType()), rows.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("c", T.BinaryType())])
    return rows, buckets, shared.table(_gathered(rows.groupBy("b").applyInArrow(name, schema), buckets))


def candidates(rows: DataFrame, buckets: int, info: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Classes that share a signature with another one: c, n, members (sorted hashes), sigs, needs (of each: twice the least number shared with a linked set, plus which band), weight (how shared they are)."""
    level = 9  # of rows that name the classes a bucket answers for
    assigned = info.filter("n_shingles > 0").groupBy("c").agg(F.min("b").alias("b")).select("b", F.lit(-1).alias("owner"), F.lit(level).alias("level"), F.col("c").alias("bits"))

    owners = X.owners(buckets)

    def wanted(right):
        return {c for c, lv in zip(right.column("bits").to_pylist(), right.column("level").to_pylist(), strict=True) if lv == level}

    def send(key, table, right):
        _, all_sigs = _all_signatures(_classes_and_sets(table.column("text"), n, wanted(right)), num, den)
        hi, _, multi, _ = X.distinct(all_sigs)
        return X.messages(key[0].as_py(), hi, None, multi, owners, coded=True)

    def keep(table, right):
        found = _classes_and_sets(table.column("text"), n, wanted(right))
        each, all_sigs = _all_signatures(found, num, den)
        hi, _, _, place = X.distinct(all_sigs)
        count = X.read_answer(right, 0, hi, None, owners, counts=True)[place]
        out, at = [], 0
        for (c, h), of_bands in zip(found.items(), each, strict=True):
            kept, needs, weight = [], [], 0
            for which, (sigs, need) in enumerate(of_bands):
                k = count[at : at + len(sigs)]
                at += len(sigs)
                if (k > 1).sum() >= need:
                    kept += sigs[k > 1].view(np.int64).tolist()
                    needs += [2 * need + which] * int((k > 1).sum())  # a set lies in two bands at most
                    weight += int(k[k > 1].sum())
            if kept:
                out.append((c, len(h), h.tobytes(), kept, needs, weight))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())
        return pa.table({x: pa.array(v, t) for x, v, t in zip(("c", "n", "members", "sigs", "needs", "weight"), columns, types, strict=True)})

    by = rows.groupBy("b")
    answers = X.answered(by.cogroup(assigned.groupBy("b")).applyInArrow(send, X.MESSAGE), False, owners, coded=True, counts_back=True)
    both = answers.unionByName(assigned)
    return by.cogroup(both.groupBy("b")).applyInArrow(keep, "c binary, n long, members binary, sigs array<long>, needs array<int>, weight long")


def _verified(pairs: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, z) that are linked."""
    a = found.select(F.col("c").alias("a"), F.col("members").alias("of_a"))
    z = found.select(F.col("c").alias("z"), F.col("members").alias("of_z"))

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("of_a"), batch.column("of_z"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort()
                shared_ = int((both[1:] == both[:-1]).sum())
                ok.append(den * shared_ >= num * (len(x) + len(y) - shared_))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("z").filter(ok)], ["a", "z"])

    return pairs.join(a, "a").join(z, "z").select("a", "z", "of_a", "of_z").mapInArrow(compare, "a binary, z binary")


def _union(batches):
    """Components of the links of one task."""
    parent: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for a, z in zip(batch.column("a").to_pylist(), batch.column("z").to_pylist(), strict=True):
            a, z = top(a), top(z)
            if a != z:
                parent[max(a, z)] = min(a, z)
    names = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([top(x) for x in names], pa.binary())], ["c", "root"])


def components(links: DataFrame) -> DataFrame:
    """(c, root) for every end of a link: root is the smallest name in its component.

    Up to SMALL_LINKS links (counted, 32 bytes each) are joined by one task.
    Beyond that, labels spread to neighbours and then jump to their labels'
    labels, so the rounds grow as the logarithm of the longest path.
    """
    if links.limit(SMALL_LINKS + 1).count() <= SMALL_LINKS:
        return shared.table(links.select("a", "z").repartition(1).mapInArrow(_union, "c binary, root binary"))
    with shared.scratch(links.sparkSession) as cut:
        return shared.table(_spread(links, cut))


def _spread(links: DataFrame, cut) -> DataFrame:
    both = cut(links.select("a", "z").unionByName(links.select(F.col("z").alias("a"), F.col("a").alias("z"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("z"), F.first("a")).alias("root")).withColumnRenamed("a", "c"))
    while True:
        heard = both.join(labels.withColumnRenamed("c", "z"), "z").groupBy("a").agg(F.min("root").alias("heard")).withColumnRenamed("a", "c")
        spread = labels.join(heard, "c").select("c", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("c").alias("root"), F.col("root").alias("next"))
        new = cut(spread.join(jump, "root", "left").select("c", "was", F.least("root", "next").alias("root")))
        if not new.filter("root <> was").limit(1).count():
            return new.select("c", "root")
        labels = new.select("c", "root")


def _compare_blocks(num: int, den: int):
    """A kernel that compares two blocks of classes (or one with itself): a link for each pair of roots that has any."""

    def kernel(key, table):
        p, q = key[1].as_py(), key[2].as_py()
        block = table.column("block").to_numpy()
        sides = [np.flatnonzero(block == p), np.flatnonzero(block == q)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"a": pa.array([], pa.binary()), "z": pa.array([], pa.binary())})
        members = [np.frombuffer(x.as_buffer(), _U) for x in table.column("members").combine_chunks()]
        size = np.array([len(x) for x in members])
        flat = [np.concatenate([members[i] for i in side]) for side in sides]
        row = [np.repeat(np.arange(len(side)), size[side]) for side in sides]
        if p == q:  # shingles of one set only can't be shared
            values, count = np.unique(flat[0], return_counts=True)
            common = values[count > 1]
        else:
            common = np.intersect1d(*flat)
        both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        at = [np.minimum(np.searchsorted(common, f), max(0, len(common) - 1)) for f in flat]
        hit = [common[i] == f if len(common) else np.zeros(len(f), bool) for i, f in zip(at, flat, strict=True)]
        order = [np.argsort(i[h], kind="stable") for i, h in zip(at, hit, strict=True)]
        at, row = [i[h][o] for i, h, o in zip(at, hit, order, strict=True)], [r[h][o] for r, h, o in zip(row, hit, order, strict=True)]
        for lo in range(0, len(common), 2048):
            part = []
            for i, r, side in zip(at, row, sides, strict=True):
                x, z = np.searchsorted(i, [lo, lo + 2048])
                m = np.zeros((len(side), 2048), np.float32)
                m[r[x:z], i[x:z] - lo] = 1
                part.append(m)
            both += part[0] @ part[1].T
        linked = den * both >= num * (size[sides[0]][:, None] + size[sides[1]][None, :] - both)
        root, c = table.column("root").to_pylist(), table.column("c").to_pylist()
        found = {}
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, z = sides[0][i], sides[1][j]
            if root[x] != root[z]:
                found.setdefault((min(root[x], root[z]), max(root[x], root[z])), (c[x], c[z]))
        return pa.table({"a": pa.array([x for x, _ in found.values()], pa.binary()), "z": pa.array([z for _, z in found.values()], pa.binary())})

    return kernel


def _telling(left: DataFrame, cut) -> DataFrame:
    """Rows (c, s, root) by which sets of different components may still be linked, each in one bucket at least with a set that it must be compared with.

    Buckets whose classes are in one component are done.  Linked sets of
    different components share all their signatures in the others, so a set
    with fewer of these than a linked one shares at least is done as well; that
    may end further buckets.  Of the rest, sets that share so many meet among
    their rarest signatures: all but need - 1 of them have to be looked at.
    """
    rows, size = left, None
    for _ in range(4):  # stopping early leaves more to compare, never less
        open_ = rows.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("f")).filter("low <> high").select("s", "f")
        held = rows.drop("f").join(open_, "s")
        enough = held.groupBy("c", "band").agg(F.count(F.lit(1)).alias("u"), F.max("need").alias("least")).filter("u >= least").select("c", "band", "u")
        rows = cut(held.drop("u").join(enough, ["c", "band"]))
        if (now := rows.count()) >= LESS * (size or 2 * now):
            break
        size = now
    rarest = Window.partitionBy("c", "band").orderBy("f", "s")
    first = rows.withColumn("k", F.row_number().over(rarest)).filter("k <= u - need + 1").select("c", "s", "root")
    open_ = first.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
    return cut(first.join(open_, "s", "left_semi"))


def linked_components(found: DataFrame, num: int, den: int, cut, buckets: int = 1) -> DataFrame:
    """(c, root) of all candidate classes that have a link."""
    spot = found.select("c", "n", "weight", F.explode(F.arrays_zip("sigs", "needs")).alias("x")).select("c", "n", "weight", F.col("x.sigs").alias("s"), (F.col("x.needs") % 2).alias("band"), F.floor(F.col("x.needs") / 2).cast("int").alias("need"))
    leader = cut(spot.groupBy("s").agg(F.max(F.struct("weight", "c", "n")).alias("lead")))
    met = spot.join(leader, "s").filter("c <> lead.c").filter(F.greatest("n", "lead.n") * num <= F.least("n", "lead.n") * den)
    met = met.groupBy(F.col("c").alias("a")).agg(F.max("lead").alias("lead")).select("a", F.col("lead.c").alias("z"))
    links = cut(_gathered(_verified(met, found, num, den), buckets))
    roots = components(links)

    few = roots.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    left = spot.select("c", "s", "band", "need").join(F.broadcast(roots) if few else roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    undone = _telling(left if few else cut(left), cut)
    if not undone.limit(1).count():
        return roots
    # classes that buckets connect form groups; a group is compared in pairs of bounded blocks
    pairs = undone.join(undone.groupBy("s").agg(F.min("c").alias("first")), "s").filter("c <> first").select(F.col("c").alias("a"), F.col("first").alias("z")).distinct()
    group = components(pairs)
    size = group.groupBy(F.col("root").alias("group")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = undone.groupBy("c").agg(F.min("root").alias("root")).join(group.select("c", F.col("root").alias("group")), "c").join(size, "group")
    rows = rows.join(found.select("c", "members"), "c").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "c", "root", "members")
    more = cut(_gathered(rows.groupBy("group", "p", "q").applyInArrow(_compare_blocks(num, den), "a binary, z binary"), buckets))
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per input row: id, n_shingles, component_id, component_rows.

    Two rows are linked if den * intersection >= num * union of their sets of
    distinct n-word shingles (texts lower-cased A-Z only; fewer words: all of
    them as one shingle).  component_id is the smallest id reachable by links,
    the row's own included; null ids are passed over, and a component without
    any other has null.  Null, empty and wordless texts have no shingles, are
    linked with nothing, and keep their own id.  Rows that repeat are linked.
    Needs 0 < num < den.  Other columns are not read.
    """
    if not 0 < num < den:
        raise ValueError("0 < num < den is needed")
    rows, buckets, info = classes(docs, id_col, text_col, n)
    with shared.scratch(docs.sparkSession) as cut:
        roots = linked_components(cut(candidates(rows, buckets, info, n, num, den)), num, den, cut, buckets)
    own = info.filter("n_shingles > 0").groupBy("c").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"))
    rooted = own.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("component_rows"))
    named = shared.table(_gathered(rooted.select("c", "root").join(lows, "root").select("c", "component_id", "component_rows"), buckets))
    full = info.filter("n_shingles > 0").join(named, "c").select("id", "n_shingles", "component_id", "component_rows")
    empty = info.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("component_rows"))
    return full.unionByName(empty).withColumnRenamed("id", id_col)

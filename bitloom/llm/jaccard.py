"""Exact n-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip), with components of its links.

1. Every text becomes its set of hashed word n-grams. Equal sets are one class, searched once.
2. Routing: for sizes a <= b, a similar pair differs in at most (a + b)(1 - t)/(1 + t) members. The members are dealt by hash
   into one part more than that, so some part holds the same members in both sets, and of many parts, more than a third. So where there are many,
   those of few members, which a passage in common makes equal, can be left out. Members that very many texts have, by a sketch of fixed size that counts
   all texts' members, are left out of the sets first, unless a set has little else. Equal parts tie documents into candidate
   clusters; each task reduces its signatures to a star per part before the shuffle, so a group of copies costs
   a row per task and not one per pair.
3. Search: the classes of a cluster meet in blocks of about BLOCK classes or MEMBERS members at most. A block has inverted lists of its members; each set
   asks for all others that hold at least T of its members: short lists are heap-merged, long ones binary-probed, and only sets that
   are not yet in the same component are looked for. What comes out is a spanning forest of the links, not all pairs.
4. Where a cluster has more than one block, a second round sets blocks against blocks, leaving out those whose members
   are all in one component already.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import Words, cut, documents, gather, map_texts, mix, text_slices
from bitloom.llm.components import components, local_components

#: Classes that meet in one block, and members of their sets; a longer set has a block of its own.
BLOCK, MEMBERS = 1024, 1_000_000
#: Signatures a routing task works on, about.
TASK_SIGNATURES = 1_500_000
#: Size of the bitmap that filters texts; a broadcast of a quarter of a million rows at most.
FILTER_BITS = 1 << 24
#: Cells of the sketch, as a power of two, and the parts that it is summed up in.
CELL_BITS, CELL_PARTS = 21, 64
#: Share of its members that a set must keep to go without the hot ones.
KEPT = 0.4
#: Chance that a similar pair has no part that counts in common.
MISSED = 1e-12

_ODD = (np.random.default_rng(11).integers(1, 2**62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


# -- sets ---------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's word n-grams; a row with fewer words has one for all of them, one without words none."""
    w = Words(data, offsets)
    h = w.hashes()
    n = w.counts
    first = np.cumsum(n) - n
    grams = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for j in range(width):
        grams += h[j : j + len(grams)] * _ODD[j]
    grams = mix(grams)
    out = []
    for lo, k in zip(first.tolist(), n.tolist()):
        if k >= width:
            out.append(np.unique(grams[lo : lo + k - width + 1]))
        elif k:
            out.append(mix(np.array([(h[lo : lo + k] * _ODD[:k]).sum(dtype=np.uint64) + np.uint64(k)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


# -- routing ------------------------------------------------------------------------------------------


class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of similar sets of a and b members."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differences(self, a: int, b: int) -> int:
        """Most members that only one of two similar sets has."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def level(self, size: int) -> tuple[int, int, int]:
        """(number, smallest, largest) of the size interval: similar sets lie in the same or in neighbouring intervals."""
        return _level(self.num, self.den, size)


@lru_cache(maxsize=100_000)
def rounds_and_members(parts: int, size: int) -> tuple[int, int]:
    """(rounds of dealing, members of a part that counts) of sets of `size` or more, for a chance of missing a similar pair of MISSED at most.

    A part holds no difference with a chance of 1/e, if there are as many differences as can be, at least one part holds none, and members follow
    a Poisson distribution. One round is enough where parts are many, and then those of few members can be left out; else more are dealt.
    """
    mean, below, term, m, first = size / parts, 0.0, math.exp(-size / parts), 1, 1.0
    while True:
        below += term  # chance of fewer than m members
        missed = min(below, (1 - (1 - below) / math.e) ** parts)
        if m == 1:
            first = missed
        if missed > MISSED:
            return (1, m - 1) if m > 1 else (math.ceil(math.log(MISSED) / math.log(first)), 1)
        term *= mean / m
        m += 1


@lru_cache(maxsize=100_000)
def _level(num: int, den: int, size: int) -> tuple[int, int, int]:
    i, lo = 0, 1
    while (hi := lo * den // num) < size:
        i, lo = i + 1, hi + 1
    return i, lo, hi


def signatures(sets: list[np.ndarray], t: Threshold, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set): similar sets, unless equal, have one in common. hot: whether a cell's members are left out where that can be.

    A set that keeps more than KEPT of its members goes without the hot ones. Where one of a similar pair keeps no more than that, the other one keeps at
    most (KEPT + 1 - t) / t; so up to there, a set goes with all its members, too.
    """
    jobs = []  # set, pairing, parts, round, least members
    whole, owner = sets, []
    sets = []
    both = (KEPT + 1 - t.num / t.den) / (t.num / t.den)
    flat = np.concatenate(whole) if whole else np.empty(0, np.uint64)
    cold = ~hot[(flat >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    ends = np.append(0, np.cumsum([len(s) for s in whole], dtype=np.int64)).tolist()
    kept = np.append(0, np.cumsum(cold))[ends].tolist()
    for number, s in enumerate(whole):
        if not len(s):
            continue
        n = kept[number + 1] - kept[number]
        variants = [] if n <= KEPT * len(s) else [(1, s[cold[ends[number] : ends[number + 1]]] if n < len(s) else s)]
        if n <= both * len(s):
            variants.append((0, s))
        i, lo, hi = t.level(len(s))
        above, below = t.level(hi + 1)[2], t.level(lo - 1)[2] if lo > 1 else 0
        for version, own in variants:
            for pairing, d in ((i, t.differences(hi, above)), (i - 1, t.differences(below, hi))):
                if pairing >= 0 and (d or pairing == i and hi > lo):
                    # of the members, up to d may be this set's alone, so that the other one has so many fewer
                    rounds, least = rounds_and_members(d + 1, max(len(own) - d, 1))
                    jobs += [(len(sets), pairing << 1 | version, d + 1, r, least) for r in range(rounds)]
            sets.append(own)
            owner.append(number)
    found, owners = [], []
    for lo in range(0, len(jobs), 20_000):
        part_of = jobs[lo : lo + 20_000]
        parts = np.array([j[2] for j in part_of], np.int64)
        salt = mix(np.array([(j[1] << 8 | j[3]) + 1 for j in part_of], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sizes = np.array([len(sets[j[0]]) for j in part_of], np.int64)
        members = np.concatenate([sets[j[0]] for j in part_of])
        base = np.cumsum(parts) - parts
        spread = mix(members ^ np.repeat(salt, sizes))
        part = ((spread >> np.uint64(32)) * np.repeat(parts, sizes).astype(np.uint64)) >> np.uint64(32)
        cell = np.repeat(base, sizes) + part.astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, cell, mix(spread))
        of = np.repeat(np.arange(len(part_of)), parts)
        counts = np.bincount(cell, minlength=len(sums)) >= np.array([j[4] for j in part_of])[of]
        sums = mix(sums + np.arange(len(sums), dtype=np.uint64) - base[of].astype(np.uint64)) ^ salt[of]
        found.append(sums[counts])
        owners.append(np.array([owner[j[0]] for j in part_of], np.int64)[of[counts]])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _stars(sigs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, smallest document of each; links from the other documents to those)."""
    order = np.lexsort((docs, sigs))
    sigs, docs = sigs[order], docs[order]
    first = np.append(True, sigs[1:] != sigs[:-1]) if len(sigs) else np.empty(0, bool)
    lead = docs[first][np.cumsum(first) - 1]
    links = docs != lead
    return sigs[first], docs[first], docs[links], lead[links]


def add_cells(held: list[np.ndarray], counts: np.ndarray) -> None:
    """Counts members in a sketch of bytes, which stop at 255."""
    new = np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(counts))
    np.minimum(counts + np.minimum(new, 255), 255, out=new)
    counts[:] = new


def summed_cells(cells: DataFrame) -> np.ndarray:
    """The sketch of all tasks (part, cells): four bytes a cell reach the driver, whatever the size of the input."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                total[part] = total[part] + own if part in total else own.astype(np.uint32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "cells"])

    out = np.zeros((CELL_PARTS, (1 << CELL_BITS) // CELL_PARTS), np.uint32)
    for row in cells.repartition(CELL_PARTS, "part").mapInArrow(run, "part int, cells binary").toArrow().to_pylist():
        out[row["part"]] = np.frombuffer(row["cells"], np.uint32)
    return out.ravel()


def candidate_links(sets: DataFrame, cells: DataFrame, texts: DataFrame, t: Threshold, width: int) -> DataFrame:
    """(a, b): documents tied by a shared signature, reduced to stars."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(0.4 * total / TASK_SIGNATURES) + 1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    counted = summed_cells(cells)
    mean = float(counted.mean())
    hot = sets.sparkSession.sparkContext.broadcast(counted > mean + 6 * math.sqrt(mean) + 20)  # of fixed size; far more than members of single texts make

    def deal(batches):
        held, owners, size = [], [], 0

        def flush():
            sigs, docs, a, b = _stars(np.concatenate(held), np.concatenate(owners))
            if len(a):
                a, b = local_components(a, b)
                a, b = a[a != b], b[a != b]
            bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # sigs are sorted, and so are these
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            rows = [(int(k), sigs[cuts[k] : cuts[k + 1]].tobytes(), docs[cuts[k] : cuts[k + 1]].tobytes()) for k in full]
            if len(a):
                spread = (mix(b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                rows += [(int(k), None, np.concatenate([a[spread == k], b[spread == k]]).tobytes()) for k in np.unique(spread)]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "sigs", "docs"])

        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                own = ids.slice(lo, hi - lo)
                known = np.array(own.is_valid(), bool)
                own = np.array(own.fill_null(0), np.int64)
                sigs, of = signatures([s if k else s[:0] for s, k in zip(shingle_sets(data, offsets, width), known)], t, hot.value)
                if len(sigs):
                    held.append(sigs)
                    owners.append(own[of])
                    size += len(sigs)
                if size >= TASK_SIGNATURES:
                    yield from flush()
                    held, owners, size = [], [], 0
        if size:
            yield from flush()

    def meet(batches):
        sigs, docs, a, b = [], [], [], []
        for batch in batches:
            for s, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s is None:
                    both = np.frombuffer(d, np.int64)
                    a.append(both[: len(both) // 2])
                    b.append(both[len(both) // 2 :])
                else:
                    sigs.append(np.frombuffer(s, np.uint64))
                    docs.append(np.frombuffer(d, np.int64))
        if sigs:
            _, _, c, d = _stars(np.concatenate(sigs), np.concatenate(docs))
            a.append(c)
            b.append(d)
        if a and len(a := np.concatenate(a)):
            a, b = local_components(a, np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    dealt = map_texts(texts, deal, "bucket int, sigs binary, docs binary")
    return dealt.repartition(buckets, "bucket").select("bucket", "sigs", "docs").mapInArrow(meet, "a bigint, b bigint")


# -- search ---------------------------------------------------------------------------------------------


def t_occurrence(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(value, occurrences) of values in at least `least` of the ascending lists: a heap merge that skips.

    Of the lists whose heads are below a value that can't reach `least`, as many as could still lack are popped and moved on by binary search.
    """
    lists = [x.tolist() for x in lists if len(x)]
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        value, same = heap[0][0], []
        while heap and heap[0][0] == value:
            same.append(heapq.heappop(heap))
        if len(same) >= least:
            found.append((value, len(same)))
            target = value + 1
        else:
            while heap and len(same) < least - 1:
                same.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], value + 1) if len(same) >= least - 1 else value + 1
        for _, i, at in same:
            x = lists[i]
            at = bisect_left(x, target, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return found


def block_links(sets: list[np.ndarray], groups: list, t: Threshold) -> list[tuple[int, int]]:
    """Spanning links (numbers of sets) among similar sets; sets of equal group are taken as linked already."""
    n = len(sets)
    order = sorted(range(n), key=lambda k: len(sets[k]))
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    members, at = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(at)
    starts = np.cumsum(counts) - counts
    posted = np.repeat(np.arange(n), sizes)[np.argsort(at, kind="stable")]
    entries = np.repeat(np.arange(len(members)), counts) * n + posted  # all lists in a row, for binary probes
    bounds = np.append(0, np.cumsum(sizes))
    numbers: dict = {}
    root = np.array([numbers.setdefault(groups[k], len(numbers)) for k in order])
    links = []
    for q in range(1, n):
        own = at[bounds[q] : bounds[q + 1]]
        size = int(sizes[q])
        least = t.overlap(size, -(-t.num * size // t.den))  # for the smallest partner
        lengths = counts[own]
        rank = np.argsort(lengths, kind="stable")
        longest = int(lengths[rank[-1]])
        if longest < 2:
            continue
        skip = min(least - 1, int(least / (0.01 * np.log2(longest) + 1)))
        short, long = own[rank[: size - skip]], own[rank[size - skip :]]
        smallest = int(np.searchsorted(sizes, -(-t.num * size // t.den)))
        short = short[counts[short] > 1]
        x = gather(posted, starts[short], counts[short])  # the short lists in a row, without what can't be or is linked
        open_ = (x >= smallest) & (x < q) & (root[x] != root[q])
        if np.bincount(x[open_], minlength=1).max() < least - skip:  # no set is in enough of them
            continue
        cuts = np.append(0, np.cumsum(open_))[np.append(0, np.cumsum(counts[short]))]
        x = x[open_]
        found = t_occurrence([x[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a], least - skip)
        found.sort(key=lambda x: -x[1])  # the likeliest first: once linked, the rest of its component needs no test
        lo, step = 0, 4
        while lo < len(found):
            own = [(c, seen) for c, seen in found[lo : lo + step] if root[c] != root[q]]
            lo, step = lo + step, min(step * 2, 256)
            if not own:
                continue
            keys = long[:, None] * n + np.array([c for c, _ in own])
            probes = np.searchsorted(entries, keys)
            held = (entries[np.minimum(probes, len(entries) - 1)] == keys).sum(0)
            for (c, seen), more in zip(own, held.tolist()):
                if root[c] != root[q] and t.linked(size, int(sizes[c]), seen + more):
                    links.append((order[q], order[c]))
                    root[root == root[c]] = root[q]
    return links


def _search(blocks: DataFrame, t: Threshold, width: int) -> DataFrame:
    """Links (a, b) within each block; blocks: (b1, b2, b3, doc, label, text), with the blocks' rows together."""

    def run(batches):
        docs, sets, labels, members, key = [], [], [], 0, None

        def flush():
            found = block_links(sets, labels, t)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in found], pa.int64()), pa.array([docs[b] for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            for lo, hi, data, offsets in text_slices(batch.column(5)):
                for (*block, doc, label), s in zip(own[lo:hi], shingle_sets(data, offsets, width)):
                    if block != key:
                        key = block
                        if len(docs) >= BLOCK or members >= MEMBERS:  # small blocks share a search; a link found across them is a true one
                            yield from flush()
                            docs, sets, labels, members = [], [], [], 0
                    docs.append(doc)
                    members += len(s)
                    sets.append(s)
                    labels.append(label)
        if len(docs) > 1:
            yield from flush()

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "b1", "b2", "b3").sortWithinPartitions("b1", "b2", "b3", "doc")
    return map_texts(dealt, run, "a bigint, b bigint")


def jaccard_components(df: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc, n_shingles, component_id) per row of df; component_id is the smallest id reachable over links of similarity >= num/den.

    Words are lower-cased in ASCII and cut at ASCII white space. A text with fewer words than `width` has its whole sequence as only
    member; null and empty texts have none and link with nothing. Rows that share an id are one node, whatever their texts. A row without id ties nothing
    together: it is returned with the smallest id among the rows of equal set, or none, as component. Other columns of df are not looked at.
    """
    t = Threshold(num, den)
    texts = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))

    def measure(batches):
        counts, held, size = np.zeros(1 << CELL_BITS, np.uint8), [], 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                held += sets
                size += sum(map(len, sets))
                if size > TASK_SIGNATURES:
                    add_cells(held, counts)
                    held, size = [], 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        *(pa.array([None] * len(sets), kind) for kind in (pa.int32(), pa.binary())),
                    ],
                    names=["doc", "n_shingles", "digest", "part", "cells"],
                )
        if size:
            add_cells(held, counts)
        if counts.any():
            parts = [x.tobytes() for x in counts.reshape(CELL_PARTS, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.array([None] * CELL_PARTS, kind) for kind in (pa.int64(), pa.int64(), pa.binary())), pa.array(range(CELL_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["doc", "n_shingles", "digest", "part", "cells"])

    measured = cut(map_texts(texts, measure, "doc bigint, n_shingles bigint, digest binary, part int, cells binary"))
    sets, cells = measured.where("part is null").select("doc", "n_shingles", "digest"), measured.where("part is not null").select("part", "cells")
    leads = sets.where("n_shingles > 0 and doc is not null").groupBy("digest").agg(F.min("doc").alias("lead"))
    led = cut(sets.join(leads, "digest", "left").select("doc", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("lead")), F.col("doc")).alias("lead")))
    clusters = components(candidate_links(sets, cells, texts, t, width)).withColumnsRenamed({"node": "doc", "component": "cluster"})
    weight = F.greatest(F.lit(1 / BLOCK), F.max("n_shingles") / F.lit(float(MEMBERS)))  # a class's share of a block
    classes = cut(led.where("doc = lead").groupBy("doc").agg(weight.alias("w")).join(clusters, "doc"))
    sized = classes.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("w").alias("all")).where("k > 1")
    classes = cut(classes.join(sized, "cluster").select("doc", "cluster", "w", F.ceil("all").cast("long").alias("blocks")))
    # round 1: each block by itself
    alone = classes.select("doc", F.col("cluster").alias("b1"), F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("b2"), F.lit(0).cast("long").alias("b3"), F.col("doc").alias("label"))
    links = cut(_search(_with_text(alone, texts), t, width))
    wide = classes.where("blocks > 1")
    if not wide.isEmpty():
        links = links.unionByName(_search(_with_text(_across(wide, components(links)), texts), t, width))
    # ids of several sets tie their classes
    again = led.where("doc is not null").groupBy("doc").agg(F.min("lead").alias("low"), F.max("lead").alias("high")).where("low <> high").select("doc")
    ties = led.join(again, "doc").select(F.col("doc").alias("a"), F.col("lead").alias("b"))
    found = components(links.unionByName(ties)).withColumnsRenamed({"node": "lead", "component": "found"})
    return led.join(found, "lead", "left").select(F.col("doc").alias(doc), "n_shingles", F.coalesce("found", "lead").alias("component_id"))


def _with_text(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """The blocks' texts. A bitmap of hashed ids, FILTER_BITS at most, is broadcast first, so that few other texts are shuffled."""
    at = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    place, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    bits = blocks.select(place.alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    near = texts.withColumn("place", place).join(F.broadcast(bits), "place").where(F.call_function("getbit", "bits", bit) == 1)
    return near.join(blocks.hint("shuffle_hash"), "doc").select("b1", "b2", "b3", "doc", "label", "text")


def _across(wide: DataFrame, found: DataFrame) -> DataFrame:
    """Round 2: pairs of blocks that may hold links between components. A component of a block or more has blocks of its own, the others
    of a cluster share mixed ones; only blocks of one and the same component are not set against each other."""
    own = wide.join(found.withColumnsRenamed({"node": "doc", "component": "c"}), "doc", "left").select("doc", "cluster", "w", F.coalesce("c", "doc").alias("label"))
    own = own.join(own.groupBy("cluster", "label").agg(F.sum("w").alias("k")), ["cluster", "label"])
    mixed = own.where("k < 1").groupBy("cluster").agg(F.ceil(F.sum("w")).cast("long").alias("m"))
    own = own.join(mixed, "cluster", "left").select(
        "doc",
        "cluster",
        "label",
        F.when(F.col("k") >= 1, F.col("label")).alias("pure"),
        F.when(F.col("k") >= 1, F.xxhash64("label", F.pmod(F.xxhash64("doc"), F.ceil("k").cast("long")))).otherwise(F.pmod(F.xxhash64("label"), F.col("m"))).alias("block"),
    )
    own = cut(own)
    blocks = own.select("cluster", "pure", "block").distinct()
    other = blocks.select("cluster", F.col("pure").alias("pure2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "cluster").where("block <= block2 and not (pure is not null and pure2 is not null and pure = pure2)")
    pairs = cut(pairs.select("cluster", "block", "block2"))
    sides = pairs.unionByName(pairs.where("block <> block2").select("cluster", F.col("block2").alias("block"), F.col("block").alias("block2")))
    dealt = own.join(sides, ["cluster", "block"])
    return dealt.select("doc", F.col("cluster").alias("b1"), F.least("block", "block2").alias("b2"), F.greatest("block", "block2").alias("b3"), "label")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles at 0.85."""
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), width=4, num=85, den=100)

"""Embedding near-dedup by a forest of random-projection trees with spill.

Every tree splits all vectors again and again at a random direction, near the node's median where the vectors are sparse, so that dense groups aren't
cut; vectors near a split go to both sides. The forest stands in two storeys. The upper one, a few trees fitted on a bounded sample, deals the vectors into cells of about BLOCK: only
here do vectors move, once per cell that they fall in. In a cell, many trees of small leaves are grown on the cell's own vectors; within
a leaf all pairs are compared, the close ones again in double precision. A pair is counted in the first cell, and there in
the first leaf, that its vectors share, so counts need no list of pairs; what leaves a task is a count per vector
and a spanning forest of links. Equal vectors are one class: tasks merge theirs before the shuffle, and cells what is left.
Cells of more than twice that are dealt as pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import cut
from bitloom.llm.components import components, local_components
from bitloom.llm.sample import bounded, fit_in_task

#: Vectors that the upper splits are fitted on, and numbers in them; at most twice as many of either.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 4_000_000
#: Vectors of a cell and of a leaf, about, and numbers in a cell.
BLOCK, LEAF, CELL_NUMBERS = 16_384, 128, 4_000_000
#: Trees of the upper storey; share of a node's vectors that go to both sides, above and in a cell.
TOPS, TOP_SPILL, SPILL = 2, 0.18, 0.06
#: Sample vectors that a node needs for a median of its own.
LEAST = 32
#: Chance that a pair at the threshold meets in a leaf of its cell.
RECALL = 0.995


def _pair_loss(threshold: float, dim: int, spill: float) -> float:
    """Chance that a level parts two unit vectors at the threshold, for normal projections: both sides of the split, and each beyond the spill."""
    spread = 1 / math.sqrt(max(dim, 1))
    gap = math.sqrt(max(2 - 2 * threshold, 0.0)) * spread
    if not gap:
        return 0.0
    width = spill * spread * math.sqrt(math.pi / 2)  # half of the spill's band around the median
    z = 2 * width / gap
    beyond = 2 * gap * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * math.erfc(z / math.sqrt(2)) / 2)
    return min(1.0, beyond / (spread * math.sqrt(2 * math.pi)))


@dataclass
class Forest:
    """Directions by tree (dimension x levels), thresholds and spill widths by tree, level and node (or one for all nodes of the level)."""

    dim: int
    directions: list[np.ndarray]
    thresholds: list[list[np.ndarray]]
    widths: list[list[np.ndarray]]

    @staticmethod
    def fit(sample: np.ndarray, rows: int, leaf: int, spill: float, trees: int | None = None, threshold: float = 0.9, seed: int = 17) -> "Forest":
        """sample: unit vectors; rows: how many vectors will be split, to about `leaf`. Without `trees`, as many as RECALL asks for."""
        depth = max(0, math.ceil(math.log2(max(rows, 1) / leaf)))
        dim = sample.shape[1]
        if trees is None:
            together = (1 - _pair_loss(threshold, dim, spill)) ** depth
            trees = math.ceil(math.log(1 - RECALL) / math.log(1 - together)) if together < RECALL else 1
        directions, thresholds, widths = [], [], []
        for t in range(trees if depth else 1):
            d = np.random.default_rng([seed, t]).normal(size=(dim, max(depth, 1)))[:, :depth]
            d /= np.linalg.norm(d, axis=0)
            p, node = sample @ d, np.zeros(len(sample), np.int64)
            cuts, near = [], []
            for level in range(depth):
                middle, width = _split(np.sort(p[:, level]), spill)
                large = np.bincount(node).max(initial=0) >= LEAST
                own, wide = np.full(1 << min(level, 20) if large else 1, middle), np.full(1 << min(level, 20) if large else 1, width)
                if large:
                    order = np.argsort(node, kind="stable")
                    bounds = np.searchsorted(node[order], np.arange(len(own) + 1))
                    for k in np.flatnonzero(np.diff(bounds) >= LEAST).tolist():
                        own[k], wide[k] = _split(np.sort(p[order[bounds[k] : bounds[k + 1]], level]), spill)
                cuts.append(own)
                near.append(wide)
                node = node * 2 + (p[:, level] > (own[node] if len(own) > 1 else own[0]))
            directions.append(d)
            thresholds.append(cuts)
            widths.append(near)
        return Forest(dim, directions, thresholds, widths)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, leaf id) of every leaf that each unit vector falls in."""
        rows, ids = [], []
        for t, (d, cuts, near) in enumerate(zip(self.directions, self.thresholds, self.widths)):
            p = x @ d
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level, (own, width) in enumerate(zip(cuts, near)):
                off = p[row, level] - (own[node] if len(own) > 1 else own[0])
                both = np.abs(off) <= (width[node] if len(width) > 1 else width[0])
                side = off > 0
                node = np.concatenate([node * 2 + side, node[both] * 2 + ~side[both]])
                row = np.concatenate([row, row[both]])
            rows.append(row)
            ids.append(np.int64(t) << np.int64(48) | node)
        return np.concatenate(rows), np.concatenate(ids)

    def table(self, x: np.ndarray) -> np.ndarray:
        """Ascending leaf ids by vector, padded with -1 at the end."""
        rows, ids = self.leaves(x)
        order = np.lexsort((ids, rows))
        rows, ids = rows[order], ids[order]
        counts = np.bincount(rows, minlength=len(x))
        out = np.full((len(x), int(counts.max(initial=1))), -1, np.int64)
        out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = ids
        return out


def _split(v: np.ndarray, spill: float) -> tuple[float, float]:
    """(threshold, half of the width around it that holds `spill` of the ascending numbers): where that band is wide, and near the median."""
    w = max(1, int(len(v) * spill / 2))
    if len(v) <= 2 * w:
        return (float(np.median(v)), 0.0) if len(v) else (0.0, 0.0)
    band = v[2 * w :] - v[: -2 * w]
    at = np.arange(w, len(v) - w)
    best = int((band * (np.minimum(at, len(v) - at) / len(v)) ** 2).argmax())
    return float(v[best] + v[best + 2 * w]) / 2, float(band[best]) / 2


def cell_size(dim: int) -> int:
    return max(1, min(BLOCK, CELL_NUMBERS // dim))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _below(table: np.ndarray, leaf: int) -> np.ndarray:
    """A bit for each leaf id below `leaf` that a row of the table has, as words of 64: two rows share such a leaf if they share a bit."""
    rows, at = np.nonzero((table >= 0) & (table < leaf))
    ids, number = np.unique(table[rows, at], return_inverse=True)
    flags = np.zeros((len(table), max(-(-len(ids) // 64), 1) * 64), bool)
    flags[rows, number] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def cell_links(x: np.ndarray, copies: np.ndarray, cells: np.ndarray, cell: int, blocks: np.ndarray, pair: tuple[int, int], threshold: float, leaf_size: int):
    """(links per vector, a, b): pairs of the cell's vectors at or above the threshold, if the cell is the first they share.

    cells: table of the upper forest's leaves; with pair (i, j), only vectors of block i against those of block j.
    """
    u, norm = _unit(x), np.linalg.norm(x, axis=1)
    small = u.astype(np.float32)
    n, links = len(x), np.zeros(len(x), np.int64)
    forest = Forest.fit(u, n, leaf_size, SPILL, threshold=threshold, seed=29)
    shared = forest.table(u)
    rows, ids = forest.leaves(u)
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
    other_cells = _below(cells, cell)
    left, right = [], []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
        own, leaf = np.sort(rows[lo:hi]), int(ids[lo])
        if len(own) < 2:
            continue
        step, earlier = max(1, 2_000_000 // len(own)), _below(shared[own], leaf)
        for at in range(0, len(own), step):
            s = small[own[at : at + step]] @ small[own].T
            p, q = np.nonzero(s >= threshold - 1e-5)
            keep = p + at < q
            p, q = p[keep] + at, q[keep]
            for k in range(0, len(p), 65_536):
                a, b = p[k : k + 65_536], q[k : k + 65_536]
                first = ~(earlier[a] & earlier[b]).any(1)
                a, b = own[a[first]], own[b[first]]
                first = ~(other_cells[a] & other_cells[b]).any(1)
                if pair[0] != pair[1]:
                    first &= blocks[a] != blocks[b]
                a, b = a[first], b[first]
                sure = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= threshold
                a, b = a[sure], b[sure]
                if len(a):
                    links += np.bincount(a, copies[b], minlength=n).astype(np.int64) + np.bincount(b, copies[a], minlength=n).astype(np.int64)
                    nodes, roots = local_components(a, b)
                    left.append(nodes[nodes != roots])
                    right.append(roots[nodes != roots])
    if not left:
        return links, np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, roots = local_components(np.concatenate(left), np.concatenate(right))
    return links, nodes[nodes != roots], roots[nodes != roots]


def vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all vectors in a row, borders, whether each vector can have links): null, empty and zero vectors can't, nor can those that hold null or
    non-finite numbers."""
    sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = lists.flatten()
    gaps = np.array(flat.is_null())
    x = np.array(flat.fill_null(0.0), np.float64)
    ends = np.append(0, np.cumsum(sizes))
    count = lambda flags: np.diff(np.append(0, np.cumsum(flags))[ends])
    return x, ends, (sizes > 0) & (count(gaps | ~np.isfinite(x)) == 0) & (count(x != 0) > 0)


def near_duplicates(df: DataFrame, threshold: float = 0.9, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec, n_links, component_id, kept) per row of df.

    Links join vectors of equal length with cosine >= threshold that meet in a leaf. Vectors that are null, empty or zero, or that hold null or
    non-finite components, link with nothing, as do rows without an id (their component is null, and they aren't kept). Rows that share an id have the
    links of their own vector each, and one component. Repeated rows link with each other. Other columns aren't looked at.
    """
    spark = df.sparkSession
    kind = df.schema[embedding].dataType.elementType.typeName()
    exact = kind in ("float", "byte", "short")  # these numbers are whole in single precision, which halves what is shuffled
    own = df.select(F.col(vec).cast("long").alias("vec"), F.col(embedding).cast("array<double>").alias("x"))

    def digests(part: pa.RecordBatch):
        x, ends, valid = vectors(part.column(1))
        valid &= np.array(part.column(0).is_valid())
        x = x + 0.0  # one zero
        raw = x.tobytes()
        keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), valid.tolist())]
        return x, ends, keys

    def digest(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                _, ends, keys = digests(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(ends))], names=["vec", "digest", "dim"])

    keyed = cut(own.mapInArrow(digest, "vec bigint, digest binary, dim bigint"))
    classes = keyed.where("digest is not null").groupBy("digest", "dim").agg(F.min("vec").alias("lead"), F.count("*").alias("copies"))
    classes = cut(classes)
    total = classes.count()
    # a forest for each length that has more vectors than a cell; vectors of other lengths are a cell a length
    cell_rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELL_NUMBERS) / F.col("dim"))))
    large = classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    forests = {int(r["dim"]): _fit(own, int(r["dim"]), int(r["n"]), threshold) for r in large.toLocalIterator()}
    shared = spark.sparkContext.broadcast(forests)  # bounded by the samples
    flat, leaf_size = "float32" if exact else "float64", LEAF

    def route(batches):
        """Rows of cells: a class is sent once a task and batch, with its copies and smallest id there."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                x, ends, keys = digests(part)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                held: dict[bytes, list] = {}
                for k, key in enumerate(keys):
                    if key is not None:
                        if key in held:
                            held[key][1] = min(held[key][1], int(ids[k]))
                            held[key][2] += 1
                        else:
                            held[key] = [k, int(ids[k]), 1]
                chosen: dict[int, list] = {}
                for key, (k, lead, copies) in held.items():
                    chosen.setdefault(int(ends[k + 1] - ends[k]), []).append((key, k, lead, copies))
                for dim, rows in chosen.items():
                    firsts = np.array([r[1] for r in rows])
                    raw = x[ends[firsts][:, None] + np.arange(dim)]
                    forest = shared.value.get(dim)
                    number, leaf = forest.leaves(_unit(raw)) if forest else (np.arange(len(rows)), np.zeros(len(rows), np.int64))
                    packed = raw.astype(np.float32) if exact else raw
                    blobs = [v.tobytes() for v in packed]
                    number = number.tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(number), dim)),
                            pa.array(leaf),
                            pa.array([rows[i][0] for i in number], pa.binary()),
                            pa.array([rows[i][2] for i in number], pa.int64()),
                            pa.array([rows[i][3] for i in number], pa.int64()),
                            pa.array([blobs[i] for i in number], pa.binary()),
                        ],
                        names=["dim", "cell", "digest", "lead", "copies", "x"],
                    )

    def size(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                x, ends, keys = digests(batch.slice(lo, 8192))
                chosen: dict[int, dict] = {}
                for k, key in enumerate(keys):
                    if key is not None:
                        chosen.setdefault(int(ends[k + 1] - ends[k]), {})[key] = k
                for dim, own_ in chosen.items():
                    firsts = np.array(list(own_.values()))
                    forest = shared.value.get(dim)
                    leaf = forest.leaves(_unit(x[ends[firsts][:, None] + np.arange(dim)]))[1] if forest else np.zeros(len(firsts), np.int64)
                    leaf, n = np.unique(leaf, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), dim)), pa.array(leaf), pa.array(n)], names=["dim", "cell", "n"])

    def compare(batches):
        held, key, names = {}, None, ("dim", "cell", "i", "j", "digest", "lead", "copies", "x", "block")

        def flush():
            if len(held) < 2:
                return
            digest_, (leads, copies, raw, blocks) = list(held), zip(*held.values())
            dim, cell, i, j = key
            x = np.frombuffer(b"".join(raw), np.dtype(flat)).reshape(-1, dim).astype(np.float64)
            forest = shared.value.get(dim)
            cells = forest.table(_unit(x)) if forest else np.zeros((len(x), 1), np.int64)
            leads, copies = np.array(leads, np.int64), np.array(copies, np.int64)
            links, a, b = cell_links(x, copies, cells, cell, np.array(blocks), (i, j), threshold, leaf_size)
            some = np.flatnonzero(links).tolist()
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([digest_[k] for k in some], pa.binary()), *(pa.array([None] * len(some), pa.int64()) for _ in "ab"), pa.array(links[some])], names=["digest", "a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(a), pa.binary()), pa.array(leads[a]), pa.array(leads[b]), pa.array([None] * len(a), pa.int64())], names=["digest", "a", "b", "n"])

        for batch in batches:
            for *at, digest_, lead, copies, x, block in zip(*(batch.column(c).to_pylist() for c in names)):
                if at != key:
                    if key is not None:
                        yield from flush()
                    held, key = {}, at
                if digest_ in held:  # the class from another task
                    before = held[digest_]
                    held[digest_] = (min(before[0], lead), before[1] + copies, before[2], before[3])
                else:
                    held[digest_] = (lead, copies, x, block)
        if key is not None:
            yield from flush()

    wide = cut(own.mapInArrow(size, "dim bigint, cell bigint, n bigint").groupBy("dim", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * cell_rows).select("dim", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks")))
    routed = own.mapInArrow(route, "dim bigint, cell bigint, digest binary, lead bigint, copies bigint, x binary")
    zero, many = F.lit(0), F.coalesce("blocks", F.lit(1))
    dealt = routed.join(wide, ["dim", "cell"], "left").withColumn("block", F.pmod(F.xxhash64("digest"), many).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, many - 1)))
    dealt = dealt.select("dim", "cell", "digest", "lead", "copies", "x", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK + 1)
    compared = dealt.repartition(parts, "dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j").mapInArrow(compare, "digest binary, a bigint, b bigint, n bigint")
    found = cut(compared)
    counts = found.where("n is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    classes = cut(classes.join(counts, "digest", "left").select("digest", "lead", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    led = keyed.join(classes, "digest", "left").select("vec", "lead", "n_links")
    # ids of several vectors tie their classes
    again = keyed.where("digest is not null").groupBy("vec").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("vec")
    ties = keyed.join(again, "vec").join(classes, "digest").select(F.col("vec").alias("a"), F.col("lead").alias("b"))
    joined = components(found.where("a is not null").select("a", "b").unionByName(ties)).withColumnsRenamed({"node": "lead", "component": "c"})
    return led.join(joined, "lead", "left").select(
        F.col("vec").alias(vec),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "lead", "vec").alias("component_id"),
        F.coalesce(F.col("vec") == F.coalesce("c", "lead", "vec"), F.lit(False)).alias("kept"),
    )


def _fit(own: DataFrame, dim: int, n: int, threshold: float) -> Forest:
    """The upper forest of vectors of one length, fitted in a task on a bounded sample."""
    rows, cell = max(1024, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim)), cell_size(dim)
    sample = bounded(own.where(F.size("x") == dim).where("vec is not null"), F.col("vec"), rows)

    def fit(table: pa.Table) -> Forest:
        lists = table.column(1).combine_chunks()
        x, ends, valid = vectors(lists if isinstance(lists, pa.Array) else lists.chunk(0))
        firsts = ends[:-1][valid]
        order = np.argsort(np.array(table.column(0))[valid], kind="stable")
        u = _unit(x[firsts[order][:, None] + np.arange(dim)]) if len(firsts) else np.zeros((0, dim))
        return Forest.fit(u, n, cell, TOP_SPILL, trees=TOPS, threshold=threshold)

    return fit_in_task(sample, fit)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of all embeddings at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

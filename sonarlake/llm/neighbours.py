"""The most similar vectors of every vector, by a forest of sorted hash strings.

Each tree hashes a vector to a string of 64 bits, the sides of 64 planes, and keeps all strings in a sorted array that is cut into ranges. A vector
descends in every tree to the strings with the longest prefix in common with its own, and ascends in all trees together: one prefix
length holds for the whole forest, and it is shortened until the strings that share it are as many as candidates are wanted. How many
share a prefix is told by the sample that the forest is fitted on; in each tree at least ``reach`` strings of the longest prefixes are
taken, by the true array. Entries carry the vector in 8-bit numbers, so that candidates are rated where they stand, and only the best leave their task;
these are compared exactly. In a group so dense that a vector finds many partners, its nearest are some of very many with about the same
string: such vectors are compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.plans.lineage import keep

TREES = 8
REACH = 32  # strings of the longest common prefixes that each tree gives at least
CANDIDATES = 4000  # strings that all trees together give, when neighbours are near
SCAN_ROWS = 2_000_000  # vectors that a task holds when all are compared
SCAN_PARTS = 16  # parts of the vectors at least, when all are compared
SCAN_SENT = 1000  # so many vectors that ask are sent to every task; more are shuffled
SAMPLE = 20_000  # vectors that planes, borders and numbers of strings under a prefix are taken from; all vectors are indexed
SAMPLE_A_PART, MOST_SAMPLE = 16, 400_000  # the sample grows with the number of ranges, up to that many
PART_ROWS = 125_000
BROADCAST_COPIES = 100_000  # more ids of copies than this are joined by an exchange
BROADCAST_PAIRS = 500_000  # more pairs than this (16 bytes each) are joined by an exchange
ASKED_TOGETHER = 32, 512  # least and greatest number of vectors that are rated by the union of their candidates
IGNORED = ("constant_0",)
_SEP = "\x1f"
_NO, _BITS = 255, 64  # level of an entry that doesn't ask; length of a string


def canonical_vectors(vectors: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """vec_id, digest, unit: the vectors of length 1 with features in one order, by name without regard to letter case.

    Null, empty, all-zero vectors, ones with a NaN or infinite value, and rows whose names don't fit the values, take no
    part. A feature that a vector lacks is 0; of a feature named twice the last counts. ``digest`` is the same for vectors of the same direction
    (to 5 decimals), so that copies are found without comparing.
    """
    named = vectors.select("vec_id", F.array_join("feature_names", _SEP, "").alias("names"), F.col("matrix").cast("array<float>").alias("matrix")).where("vec_id is not null and names is not null and size(matrix) > 0")
    # as many names as there are features, whatever the number of rows; layouts are made distinct before they are split
    layouts = named.select("names").distinct().select(F.explode(F.split("names", _SEP)).alias("f"))
    features = sorted(r.f for r in layouts.select(F.lower("f").alias("f")).distinct().collect() if r.f and r.f not in ignored)
    place = {f: i for i, f in enumerate(features)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        for b in batches:
            layout = b["names"].dictionary_encode()
            code, matrix = layout.indices.to_numpy(), b["matrix"]
            offsets, flat = matrix.offsets.to_numpy(), matrix.values.to_numpy(zero_copy_only=False)
            size, ids = np.diff(offsets), b["vec_id"].to_numpy()
            out = np.zeros((b.num_rows, len(features)), np.float32)
            valid = np.zeros(b.num_rows, bool)
            for c, names in enumerate(layout.dictionary.to_pylist()):
                if names not in known:
                    if len(known) > 10_000:
                        known.clear()
                    split = [place.get(x.lower(), -1) for x in names.split(_SEP)]
                    at = {p: i for i, p in enumerate(split) if p >= 0}
                    known[names] = np.array(list(at.values()), int), np.array(list(at), int), len(split)
                source, target, n = known[names]
                rows = np.flatnonzero((code == c) & (size == n))
                if rows.size:
                    block = flat[offsets[rows][:, None] + np.arange(n)]
                    out[rows[:, None], target] = block[:, source]
                    valid[rows] = np.isfinite(block).all(1)
            norm = np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64))
            valid &= norm > 0
            unit = (out[valid] / norm[valid, None]).astype(np.float32)
            keys = np.round(unit * 1e5).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[valid]), pa.array([blake2b(k.tobytes(), digest_size=16).digest() for k in keys], pa.binary()), pa.array([u.tobytes() for u in unit], pa.binary())],
                ["vec_id", "digest", "unit"],
            )

    return named.mapInArrow(read, "vec_id long, digest binary, unit binary")


def bisecting_planes(sample: np.ndarray, trees: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree the normals and offsets of 64 planes that halve the sample.

    Normals are random rotations stretched along the directions in which the sample spreads: planes cut where vectors differ, and those of one tree say different things.
    """
    d = sample.shape[1]
    _, spread, axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)
    out = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        turns = [np.linalg.qr(rng.standard_normal((d, d)))[0][: len(spread)] for _ in range(ceil(_BITS / d))]
        normals = np.concatenate([(axes.T * spread) @ q for q in turns], axis=1)[:, :_BITS]
        dull = np.linalg.norm(normals, axis=0) < 1e-9  # all of the sample in one direction
        normals[:, dull] = rng.standard_normal((d, int(dull.sum())))
        normals = normals.astype(np.float32)
        out.append((normals, np.median(sample @ normals, axis=0)))
    return out


def hash_strings(unit: np.ndarray, planes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The strings of 64 bits of one tree as unsigned integers, whose order is that of the strings."""
    return np.packbits(unit @ planes[0] > planes[1], axis=1).view(">u8")[:, 0].astype(np.uint64)


def prefix_range(h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string with the first ``level`` bits of ``h``."""
    low = np.where(level > 0, np.uint64(0xFFFFFFFFFFFFFFFF) << np.minimum(_BITS - level, 63).astype(np.uint64), np.uint64(0))
    return h & low, h | ~low


def longest_prefix(h: np.ndarray, sorted_strings: list[np.ndarray], wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """The longest prefix length at which arrays hold ``wanted`` strings together, and how many they hold there. ``h``: a row for each array."""
    n = h.shape[1]
    low, high = np.zeros(n, int), np.full(n, _BITS)
    held = np.full(n, sum(map(len, sorted_strings)))
    for _ in range(7):
        level = (low + high + 1) // 2
        count = np.zeros(n, int)
        for mine, strings in zip(h, sorted_strings):
            a, b = prefix_range(mine, level)
            count += np.searchsorted(strings, b, side="right") - np.searchsorted(strings, a)
        enough = count >= wanted
        held = np.where(enough & (level > low), count, held)
        low, high = np.where(enough, level, low), np.where(enough, high, np.maximum(level - 1, low))
    return low, held


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column)
    return np.frombuffer(raw, np.float32).reshape(len(column), -1)


def best_pairs(asker: np.ndarray, ids: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of every asker, by cosine and then id, in the order of askers; repeated pairs count once."""
    order = np.lexsort((ids, -cosine, asker))
    asker, ids, cosine = asker[order], ids[order], cosine[order]
    new = np.ones(len(ids), bool)
    new[1:] = (asker[1:] != asker[:-1]) | (ids[1:] != ids[:-1])
    asker, ids, cosine = asker[new], ids[new], cosine[new]
    first = np.flatnonzero(np.r_[True, asker[1:] != asker[:-1]]) if len(asker) else np.empty(0, int)
    top = np.arange(len(asker)) - np.repeat(first, np.diff(np.r_[first, len(asker)])) < k
    return asker[top], ids[top], cosine[top]


class Scan:
    """Vectors that ask, compared with every vector that is shown: the ``k`` best of each with a cosine of at least ``least``, exactly."""

    PENDING = 500_000

    def __init__(self, ids: np.ndarray, unit: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.unit, self.least, self.k = ids, unit, least.astype(np.float32), k
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def see(self, ids: np.ndarray, unit: np.ndarray) -> None:
        for i in range(0, len(self.ids), 1024):
            for j in range(0, len(ids), 2048):
                ask, shown = self.unit[i : i + 1024], unit[j : j + 2048]
                near = np.flatnonzero(ask @ shown.T >= self.least[i : i + 1024, None])
                for n in range(0, len(near), self.PENDING):
                    r, c = np.divmod(near[n : n + self.PENDING], len(shown))
                    other = self.ids[i + r] != ids[j + c]
                    r, c = i + r[other], j + c[other]
                    self.pairs.append((r, ids[c], np.einsum("ij,ij->i", self.unit[r], unit[c], dtype=np.float64)))
                    self.pending += len(r)
                    if self.pending > self.PENDING:
                        self.shrink()

    def shrink(self) -> None:
        """Keep the best; whoever has ``k`` needs no worse ones."""
        r, ids, cosine = best_pairs(*(np.concatenate(z) for z in zip(*self.pairs)), self.k)
        self.pairs, self.pending = [(r, ids, cosine)], 0
        full = np.flatnonzero(np.bincount(r, minlength=len(self.ids)) == self.k)
        last = np.searchsorted(r, full, side="right") - 1
        self.least[full] = np.maximum(self.least[full], cosine[last] - 1e-5)  # 32-bit products are that near

    def batch(self) -> pa.RecordBatch:
        if self.pairs:
            self.shrink()
        r, ids, cosine = self.pairs[0] if self.pairs else (np.empty(0, int), np.empty(0, np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r], pa.int64()), pa.array(ids, pa.int64()), pa.array(cosine, pa.float64())], ["a", "b", "cosine"])


def scanned_pairs(units: DataFrame, askers: DataFrame, rows: int, asking: int, k: int, min_cosine: float | None, seed: int = 5) -> DataFrame:
    """The exact ``k`` nearest b of every a of ``askers`` among all ``units``: a, b, cosine. Both hold id, unit, maybe repeated.

    The k-th best in a sample is a bound that most vectors fail at once. All the same every asker meets every vector, so time grows with the product of both.
    Vectors are shuffled once, askers once for each part of them.
    """
    # distinct, since a repeated row would be taken for two neighbours
    sample = {r.id: r.unit for r in units.select("id", "unit").sample(min(1.0, SAMPLE * 1.2 / max(1, rows)), seed).limit(SAMPLE).collect()}
    some = _matrix(list(sample.values())) if sample else None
    floor = -2.0 if min_cosine is None else min_cosine - 1e-5

    def bounds(unit: np.ndarray) -> np.ndarray:
        out = np.full(len(unit), floor, np.float32)
        if some is not None and len(some) > k:
            for i in range(0, len(unit), 256):
                score = unit[i : i + 256] @ some.T  # with the asker itself, maybe: hence the next one
                out[i : i + 256] = np.maximum(floor, np.partition(score, -k - 1, axis=1)[:, -k - 1] - 1e-5)
        return out

    pairs = "a long, b long, cosine double"
    if asking <= SCAN_SENT:
        sent = {r.id: r.unit for r in askers.select("id", "unit").collect()}
        if not sent:
            return units.sparkSession.createDataFrame([], pairs)
        ask_ids, ask_unit = np.array(list(sent), np.int64), _matrix(list(sent.values()))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scan(ask_ids, ask_unit, bounds(ask_unit), k)
            for b in batches:
                if b.num_rows:
                    scan.see(b["id"].to_numpy(), _matrix(b["unit"]))
            yield scan.batch()

        found = units.select("id", "unit").mapInArrow(meet, pairs)
    else:
        parts = max(SCAN_PARTS, ceil(rows / SCAN_ROWS))

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b["id"], b["unit"], pa.array(bounds(_matrix(b["unit"])), pa.float32())], ["id", "unit", "least"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for whole in batches:
                vectors = whole.num_rows - pc.sum(whole["asks"]).as_py() if whole.num_rows else 0
                if vectors:
                    b = whole.slice(0, vectors)
                    held.append((b["id"].to_numpy(), _matrix(b["unit"])))
                if vectors < whole.num_rows:
                    b = whole.slice(vectors)
                    scan = Scan(b["id"].to_numpy(), _matrix(b["unit"]), b["least"].to_numpy(), k)
                    for ids, unit in held:
                        scan.see(ids, unit)
                    yield scan.batch()

        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        ask = askers.select("id", "unit").dropDuplicates(["id"]).mapInArrow(bounded, "id long, unit binary, least float").select("id", "unit", "least", F.lit(True).alias("asks"), every)
        shown = units.select("id", "unit", F.lit(0.0).cast("float").alias("least"), F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
        # a partition is one part of the vectors, and after them all askers
        found = shown.unionByName(ask).repartitionById(parts, "part").sortWithinPartitions("asks").mapInArrow(meet, pairs)
    best = found.repartition("a").dropDuplicates(["a", "b"]).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b")))
    return best.where(F.col("r") <= k).drop("r")


def _ids(values) -> np.ndarray:
    return np.asarray(values, np.int64)


def side_by_side(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts ranges of about one size, sorted by their start, into runs whose union is hardly longer than one of them; runs of few ranges may be longer."""
    few, many = ASKED_TOGETHER
    new = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(lo) else np.empty(0, int)
    start = 0
    for i, end in zip(new.tolist(), np.r_[new[1:], len(lo)].tolist()):
        if i > start and (lo[i] < lo[start] or i - start >= few and hi[i] - lo[start] > 1.5 * (hi[start] - lo[start])):
            yield start, i
            start = i
        while end - start >= many:
            yield start, start + many
            start += many
    if start < len(lo):
        yield start, len(lo)


def rate_candidates(
    h: np.ndarray, ids: np.ndarray, unit: np.ndarray, ask: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], reach: int, best: int, least: float | None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asker, other, score) of the ``best`` candidates of every asker in a range of one tree's sorted array, scores above ``least`` only.

    ``ask``: strings, ids, vectors and levels of those that ask. Askers whose candidates stand side by side are rated together, by all that any of them is shown.
    """
    ah, aid, aunit, alevel = ask
    a, b = prefix_range(ah, alevel)
    lo, hi = np.searchsorted(h, a), np.searchsorted(h, b, side="right")
    mine, _ = longest_prefix(ah[None], [h], min(reach, len(h)))
    a, b = prefix_range(ah, mine)
    lo, hi = np.minimum(lo, np.searchsorted(h, a)), np.maximum(hi, np.searchsorted(h, b, side="right"))
    order = np.lexsort((aid, lo, np.log2(np.maximum(hi - lo, 1)).astype(int)))
    floor = -2.0 if least is None else least
    for i, j in side_by_side(lo[order], hi[order]):
        q = order[i:j]
        first, last = int(lo[q].min()), int(hi[q].max())
        bound = np.full(len(q), floor, np.float32)
        some = np.arange(first, last, 8)
        if least is None and len(some) > best + 1:  # the best of an eighth are a bound for the best of all
            for j in range(0, len(q), 64):
                part = aunit[q[j : j + 64]] @ unit[some].T
                bound[j : j + 64] = np.maximum(floor, np.partition(part, len(some) - best - 1, axis=1)[:, len(some) - best - 1] - 1e-6)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(first, last, 4096):
            score = aunit[q] @ unit[j : min(j + 4096, last)].T
            r, c = np.divmod(np.flatnonzero(score >= bound[:, None]), score.shape[1])
            other = aid[q[r]] != ids[j + c]
            r, c = r[other], c[other]
            held.append((aid[q[r]], ids[j + c], score[r, c]))
            if sum(len(x[0]) for x in held) > 1_000_000:
                held = [best_pairs(*(np.concatenate(z) for z in zip(*held)), best)]
        if held:
            yield best_pairs(*(np.concatenate(z) for z in zip(*held)), best)


def neighbour_pairs(units: DataFrame, rows: int, k: int, min_cosine: float | None, trees: int = TREES, reach: int = REACH, candidates: int = CANDIDATES, seed: int = 5) -> DataFrame:
    """Pairs of different vectors with their exact cosine: a, b, cosine; b is a neighbour of a. ``units``: id, asks, unit; read several times, rows may be repeated.

    The best by 8-bit numbers (4k of each tree with ``min_cosine``, else 2k) are put together and the best of these (4k or 2k) compared exactly.
    """
    parts = max(1, ceil(rows / PART_ROWS))
    size = min(MOST_SAMPLE, SAMPLE + SAMPLE_A_PART * parts)
    sample = units.select("unit").sample(min(1.0, size * 1.2 / max(1, rows)), seed).limit(size).collect()
    if not sample:
        return units.sparkSession.createDataFrame([], "a long, b long, cosine double")
    some = np.stack([np.frombuffer(r.unit, np.float32) for r in sample])
    d = some.shape[1]
    planes = bisecting_planes(some[:SAMPLE], trees, seed)
    strings = [np.sort(hash_strings(some, p)) for p in planes]
    borders = [s[(np.arange(1, parts) * len(s)) // parts] for s in strings]
    told = [np.sort(hash_strings(some[:SAMPLE], p)) for p in planes]
    weight = rows / len(told[0])  # vectors that one of the sample stands for
    best = (2 if min_cosine is None else 4) * k
    least = None if min_cosine is None else min_cosine - 0.01  # what 8-bit numbers may be off by
    record = np.dtype([("h", "<u8"), ("id", "<i8"), ("level", "u1"), ("code", "i1", d)])

    def levels(h: np.ndarray) -> np.ndarray:
        """The prefix length to which all trees ascend; where the sample is too thin to tell, prefixes are taken to halve with every bit."""
        level, held = longest_prefix(h, told, max(8.0, candidates / weight))
        deeper = np.log2(np.maximum(held * weight / max(1, candidates), 1.0))
        return np.minimum(_BITS, level + np.where(held <= 16 * trees, np.floor(deeper), 0)).astype(int)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, asks, ids = _matrix(batch["unit"]), batch["asks"].to_numpy(zero_copy_only=False).astype(bool), _ids(batch["id"])
            h = np.stack([hash_strings(unit, p) for p in planes])
            level = np.full(len(ids), _NO)
            if asks.any():
                level[asks] = levels(h[:, asks])
            made = np.empty(len(ids), record)
            made["id"], made["level"] = ids, level
            made["code"] = np.round(unit * (127 / np.maximum(np.abs(unit).max(1, keepdims=True), 1e-30)))
            out: tuple[list, list, list] = ([], [], [])
            for t in range(trees):
                made["h"] = h[t]
                right = np.searchsorted(borders[t], h[t], side="right")
                same = right - np.searchsorted(borders[t], h[t], side="left")  # a string that fills ranges is dealt to them by id
                own = np.where(same > 1, right - (ids * 0x9E3779B1 % 0x7FFFFFFF) % np.maximum(same, 1), right)
                a, b = prefix_range(h[t], np.where(asks, level, _BITS))
                first, last = np.searchsorted(borders[t], a, side="right"), np.searchsorted(borders[t], b, side="right")
                first, last = np.where(asks & (same <= 1), first, own), np.where(asks & (same <= 1), last, own)
                # to its own range as an entry; to the others that hold strings of its prefix as a question
                for asked, target, rows_ in [(False, own, np.arange(len(ids))), *((True, first + i, np.flatnonzero((first + i <= last) & (first + i != own))) for i in range(int((last - first).max()) + 1))]:
                    target = target[rows_]
                    order = np.argsort(target, kind="stable")
                    cut = np.flatnonzero(np.r_[True, np.diff(target[order]) != 0]) if len(order) else np.empty(0, int)
                    for i, j in zip(cut, np.r_[cut[1:], len(order)]):
                        out[0].append(int(target[order[i]]) + t * parts)
                        out[1].append(asked)
                        out[2].append(made[rows_[order[i:j]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())], ["part", "asked", "entries"])

    def unique(blobs: list[bytes]) -> np.ndarray:
        all_ = np.frombuffer(b"".join(blobs), record)
        all_ = all_[np.lexsort((all_["level"], all_["id"], all_["h"]))]
        return all_[np.r_[True, (all_["id"][1:] != all_["id"][:-1]) | (all_["h"][1:] != all_["h"][:-1])]] if len(all_) else all_

    def lengthened(code: np.ndarray) -> np.ndarray:
        unit = code.astype(np.float32)
        return unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in batches:
            for part, asked, blob in zip(batch["part"].to_pylist(), batch["asked"].to_pylist(), batch["entries"].to_pylist()):
                tree.setdefault(part, ([], []))[asked].append(blob)
        for held, asked in tree.values():
            entries, guests = unique(held), unique(asked)
            if not len(entries):
                continue
            unit = lengthened(entries["code"])
            own = entries["level"] != _NO
            ask = tuple(np.concatenate(z) for z in ((entries["h"][own], guests["h"]), (entries["id"][own], guests["id"]), (unit[own], lengthened(guests["code"])), (entries["level"][own].astype(int), guests["level"].astype(int))))
            if len(ask[0]):
                for a, b, s in rate_candidates(entries["h"].copy(), entries["id"].copy(), unit, ask, reach, best, least):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["a", "b", "s"])

    # a partition is a range of one tree's sorted array
    planted = units.select("id", "asks", "unit").mapInArrow(plant, "part int, asked boolean, entries binary").repartitionById(trees * parts, "part")
    rated = planted.mapInArrow(climb, "a long, b long, s float").groupBy("a", "b").agg(F.max("s").alias("s"))
    pairs = keep(rated.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= best).select("a", "b"))
    bounded = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    vectors = units.select("id", "unit")
    others = vectors.withColumnsRenamed({"id": "b", "unit": "w"}).join(bounded(pairs), "b")
    askers = vectors.withColumnsRenamed({"id": "a", "unit": "u"}).join(bounded(pairs.select("a").distinct()), "a", "left_semi").dropDuplicates(["a"])

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = np.einsum("ij,ij->i", _matrix(b["u"]), _matrix(b["w"]), dtype=np.float64)
            out = pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(c)], ["a", "b", "cosine"])
            yield out if min_cosine is None else out.filter(pc.greater_equal(out["cosine"], min_cosine - 1e-7))

    return others.join(askers, "a").select("a", "b", "u", "w").mapInArrow(cosine, "a long, b long, cosine double")


def nearest(vectors: DataFrame, k: int = 10, min_cosine: float | None = None, asks: Column | None = None, trees: int = TREES, reach: int | None = None, share: float | None = None, seed: int = 5) -> DataFrame:
    """The ``k`` most similar other vectors of every vector that ``asks`` (all by default): vec_id, other_id, cosine, rank (by cosine, then other_id).

    ``asks`` is a condition on vec_id; all vectors are searched. With ``min_cosine`` only neighbours of at least that cosine are given.
    ``reach`` is how many strings of the longest common prefixes each tree gives at least (REACH by default), ``share`` which part of all vectors the trees
    together give as candidates (CANDIDATES of them by default). With none of the three, the vectors that ask are compared with all, exactly; with min_cosine
    those are that have found half of k or more. Vectors that are null, empty, all zero or hold a NaN
    take no part; repeated rows count once; copies of a direction (also scaled ones) are compared once and then
    expanded, up to k of them for each vector. An empty table gives an empty result; other columns are ignored.
    """
    asks = F.lit(True) if asks is None else asks
    units = keep(canonical_vectors(vectors))
    low = Window.partitionBy("digest").orderBy("vec_id")
    once = keep(units.groupBy("digest", "vec_id").agg(F.lit(1).alias("one")).drop("one"))
    # Spark keeps the first k + 1 of a group in each task before the exchange: a hot group of copies is not gathered
    lows = once.withColumn("rn", F.row_number().over(low)).where(F.col("rn") <= k + 1).select("digest", F.col("vec_id").alias("other_id"), "rn")
    names = keep(once.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.max(asks).alias("any_asks")))
    copied = names.agg(F.sum(F.col("size") - 1)).first()[0] or 0
    reps = units.select(F.col("vec_id").alias("id"), asks.alias("asks"), "unit")
    if copied:
        bounded = F.broadcast if copied <= BROADCAST_COPIES else (lambda df: df)
        copies = once.join(names.where("size > 1"), "digest").where("vec_id <> id").select(F.col("vec_id").alias("id"))
        # a copy may ask where the vector that stands for it does not
        heard = names.where("size > 1 and any_asks").select("id", F.lit(True).alias("heard"))
        reps = reps.join(bounded(copies), "id", "left_anti").join(bounded(heard), "id", "left").select("id", (F.col("asks") | F.coalesce("heard", F.lit(False))).alias("asks"), "unit")
    rows = units.count()
    if min_cosine is None and reach is None and share is None:
        asking = names.where("any_asks").count()
        found = keep(scanned_pairs(reps, reps.where("asks"), rows, asking, k, None, seed))
    else:
        wanted = CANDIDATES if share is None else ceil(share * rows)
        found = neighbour_pairs(reps, rows, k, min_cosine, trees, reach or REACH, wanted, seed)
        if min_cosine is not None:
            found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
        found = keep(found.dropDuplicates(["a", "b"]))
    if min_cosine is not None:
        # in a dense group the nearest lie beyond any fixed reach: whoever has found many is compared with all
        crowded = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where(F.col("count") >= max(1, k // 2)).select("id")
        crowded = keep(reps.where("asks").select("id").distinct().join(crowded, "id", "left_semi"))
        if many := crowded.count():
            exact = scanned_pairs(reps, reps.where("asks").join(crowded, "id", "left_semi"), rows, many, k, min_cosine, seed).where(F.col("cosine") >= min_cosine - 1e-7)
            exact = exact.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
            found = keep(found.unionByName(exact).dropDuplicates(["a", "b"]))
    mutual = found if min_cosine is None else found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    near = mutual.unionByName(names.where("size > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")))
    names = names.select("id", "digest")
    of = near.join(names.withColumnsRenamed({"id": "a", "digest": "from_digest"}), "a").join(names.withColumnsRenamed({"id": "b", "digest": "to_digest"}), "b")
    others = of.select("from_digest", "to_digest", "cosine").join(lows.withColumnRenamed("digest", "to_digest"), "to_digest").select("from_digest", "other_id", "cosine")
    # k + 1 suffice for every member: it may be among them itself
    best = others.withColumn("rn", F.row_number().over(Window.partitionBy("from_digest").orderBy(F.desc("cosine"), "other_id"))).where(F.col("rn") <= k + 1)
    members = once.where(asks).select(F.col("digest").alias("from_digest"), "vec_id")
    out = best.select("from_digest", "other_id", "cosine").join(members, "from_digest").where("vec_id <> other_id")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "other_id", "cosine", "rank")


def similar_pairs(vectors: DataFrame, k: int = 10, min_cosine: float = 0.96) -> DataFrame:
    """Pairs vec_a < vec_b of which one is among the ``k`` nearest of the other, with a cosine of at least ``min_cosine``."""
    near = nearest(vectors, k, min_cosine)
    return near.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()

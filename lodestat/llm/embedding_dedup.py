"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.links import compare_in_groups, components, resolve
from lodestat.llm.scratch import Scratch

SIMILARITY = 0.98
#: Bits of a code, least Hamming distance searched for that many bits, and vectors that the rotation is learnt from.
BITS, RADIUS, SAMPLE = 64, 7, 20_000
#: Share of pairs at the similarity that must be found in the sample, most codes for it, and sampled pairs.
RECALL, CODES, TRIALS = 0.95, 32, 4000
_SEEDED = 11


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class key (label and vector), space (label and dimension) and vector; null for what links with nothing."""
    for batch in batches:
        keys, spaces, kept = [], [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            values = None
            if label is not None and vector.is_valid and vector.values.null_count == 0 and len(vector.values):
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(values).all() or not values.any():
                    values = None
            if values is None:
                keys.append(None)
                spaces.append(None)
            else:
                spaces.append(f"{len(values)}|{label}")
                keys.append(hashlib.blake2b(spaces[-1].encode() + b"\0" + values.tobytes(), digest_size=16).digest())
            kept.append(values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(spaces, pa.string()), pa.array(kept, pa.list_(pa.float64()))], ["vec_id", "key", "space", "vector"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors to `bits` values whose signs are balanced binary codes.

    Principal directions, then a rotation that is alternately fitted to the codes and refines them.
    """
    mean = x.mean(axis=0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    principal = vectors[:, ::-1][:, : min(bits, x.shape[1])]
    v = (x - mean) @ principal
    rotation = np.linalg.qr(np.random.default_rng(_SEEDED).standard_normal((v.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, principal @ rotation


@dataclass
class Model:
    """Mean, projections (one a code) and the Hamming distance to search; no projection: compare all vectors of a space."""

    mean: np.ndarray
    projections: list[np.ndarray]
    radius: int


def _partners(x: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at exactly the similarity from those of x: off in any direction, and in those in which vectors differ."""
    draw = np.random.default_rng(_SEEDED + 1)
    out = []
    for away in (draw.standard_normal(x.shape), x[draw.permutation(len(x))] - x):
        away = away - (away * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.where(length > 1e-9, away / np.maximum(length, 1e-9), 0.0)
        out.append(similarity * x + np.sqrt(max(0.0, 1 - similarity**2)) * away)
    return out[0], out[1]


def learn_model(x: np.ndarray, n: int, similarity: float) -> Model:
    """Codes of the unit vectors x, a sample of n, by which RECALL of the pairs at the similarity are within the radius.

    One learnt code and RADIUS if that is enough. Else random rotations of the centred vectors give further codes, and
    the radius is the one with the least work of those at which few codes agree by chance. Bit flips are counted on
    sampled vectors and partners placed at the similarity. Where CODES are not enough there is no projection.
    """
    mean, projection = learn_rotation(x)
    bits = projection.shape[1]
    some = x[np.random.default_rng(_SEEDED).permutation(len(x))[:TRIALS]]
    pairs = [(some, p) for p in _partners(some, similarity)]
    draw = np.random.default_rng(_SEEDED + 2)
    least = -(-RADIUS * bits // BITS)
    reach = range(least, 2 * least + 1)
    met = np.zeros((len(reach), 2, len(some)), bool)
    projections, best = [], None
    while len(projections) < CODES:
        if projections:
            projection = projections[0] @ np.linalg.qr(draw.standard_normal((bits, bits)))[0]
        projections.append(projection)
        for kind, (a, b) in enumerate(pairs):
            flips = (((a - mean) @ projection >= 0) != ((b - mean) @ projection >= 0)).sum(axis=1)
            met[:, kind] |= flips <= np.array(reach)[:, None]
        for k, radius in enumerate(reach):
            chance = n * len(projections) * sum(math.comb(bits, i) for i in range(radius + 1)) / 2.0**bits
            if met[k].mean(axis=1).min() >= RECALL and (radius == least or chance <= 0.1):
                parts, distance = tables(bits, n, radius)
                work = len(projections) * sum(math.comb(width, d) for _, width in parts for d in range(distance + 1))
                best = min(best or (work, len(projections), radius), (work, len(projections), radius))
        if best and best[1] == 1 and best[2] == least:
            break
    return Model(mean, projections[: best[1]] if best else [], best[2] if best else 0)


def _encoder(models: dict[int, Model]):
    """Codes of each vector, numbered by turn, and the node that stands for (space, turn, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, vectors = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            rows, codes, turns, radius = [], [], [], []
            for size in np.unique(sizes):
                at, model = np.flatnonzero(sizes == size), models[int(size)]
                x = _unit(np.array([vectors[i] for i in at])) - model.mean
                for turn, projection in enumerate(model.projections or [np.zeros((size, 1))]):
                    ones = x @ projection >= 0
                    codes.append((ones.astype(np.uint64) << np.arange(ones.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
                    rows.append(at)
                    turns.append(np.full(len(at), turn, np.int32))
                    radius.append(np.full(len(at), model.radius, np.int32))
            if not rows:
                continue
            at, codes, turns, radius = (np.concatenate(x) for x in (rows, codes, turns, radius))
            nodes = [hashlib.blake2b(int(c).to_bytes(8, "big") + bytes([t]) + spaces[i].encode(), digest_size=16).digest() for i, c, t in zip(at, codes, turns, strict=True)]
            named = [batch.column(k).take(pa.array(at)) for k in (0, 1)]
            columns = [*named, pa.array(codes.view(np.int64)), pa.array(nodes, pa.binary()), pa.array(np.minimum(sizes[at], BITS), pa.int32()), pa.array(turns), pa.array(radius)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "space", "code", "node", "bits", "turn", "radius"])

    return run


def tables(bits: int, n: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """(first bit, width) of the substrings for n codes, and the distance to search in each.

    Substrings are about log2(n) bits wide, so that a bucket holds few codes by chance. Two codes within the radius differ
    by no more than the returned distance in one of them.
    """
    m = int(np.clip(round(bits / max(8.0, np.log2(max(n, 2)))), 1, bits))
    cuts = np.linspace(0, bits, m + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)], -(-(radius + 1) // m) - 1


def _probes(n: int):
    """Each code in its own bucket of every table (home), and in the buckets within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bits = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            turns, radius = batch.column(4).to_pylist(), batch.column(5).to_numpy()
            spaces = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8, salt=bytes([t])).digest(), "big") for s, t in zip(batch.column(1).to_pylist(), turns, strict=True)], np.uint64)
            out = []
            for size, reach in np.unique(np.stack([bits, radius]), axis=1).T:
                at = np.flatnonzero((bits == size) & (radius == reach))
                parts, distance = tables(int(size), n, int(reach))
                for t, (first, width) in enumerate(parts):
                    own = codes[at] >> np.uint64(first) & np.uint64((1 << width) - 1)
                    for d in range(distance + 1):
                        for flips in combinations(range(width), d):
                            bucket = own ^ np.uint64(sum(1 << f for f in flips))
                            group = (spaces[at] ^ (bucket + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(2 * t + 1)
                            out.append((group, at, np.full(len(at), d == 0)))
            group, at, home = (np.concatenate(x) for x in zip(*out, strict=True))
            taken = [batch.column(k).take(pa.array(at)) for k in (0, 2, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), *taken, pa.array(home)], ["grp", "key", "code", "radius", "home"])

    return run


def _near_codes(columns: dict, starts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a bucket within the Hamming radius, one of which is at home there."""
    codes, home = columns["code"].to_numpy().view(np.uint64), columns["home"].to_numpy(zero_copy_only=False)
    radius = np.maximum(columns["radius"].to_numpy(), RADIUS)
    found = [np.zeros((2, 0), np.int64)]
    for low, high in zip(starts[:-1], starts[1:], strict=True):
        a, b = (x + low for x in np.triu_indices(high - low, 1))
        ok = (home[a] | home[b]) & (np.bitwise_count(codes[a] ^ codes[b]) <= radius[a])
        found.append(np.stack([a[ok], b[ok]]))
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


def _near_vectors(similarity: float):
    def match(columns: dict, starts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = columns["vector"]
        offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            if high - low > 1:
                x = _unit(flat[offsets[low] : offsets[high]].reshape(high - low, -1))
                a, b = np.nonzero(np.triu(x @ x.T >= similarity, 1))
                found.append(np.stack([a + low, b + low]))
        pairs = np.concatenate(found, axis=1)
        return pairs[0], pairs[1]

    return match


def near_vectors(rows: DataFrame, similarity: float = SIMILARITY, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Link vectors of one label whose cosine, in double precision, is `similarity` or more.

    Returns one row per vector: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable)
    and kept (vec_id is component_id). Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; vectors of different dimension do not either. Repeated rows link with each other.
    Ids may be null; other columns are ignored.

    Equal vectors of a label are one class. A rotation learnt on at most about SAMPLE classes of each dimension turns
    classes into binary codes; every code is looked up in the multi-index tables, and codes within the radius form
    candidate groups, inside which all vectors are compared by their cosines in blocks. Radius and number of codes come
    from the bits that flip between sampled vectors and partners at the similarity (see learn_model), so vectors with
    a common direction are searched farther; where no codes serve, all vectors of a label are compared.
    """
    scratch = Scratch(rows.sparkSession)
    given = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("vector"))
    keyed = scratch.store(given.mapInArrow(_keys, "vec_id long, key binary, space string, vector array<double>"))
    classes = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("space").alias("space"), F.first("vector").alias("vector"))
    classes = scratch.store(classes)

    many = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    models = {}
    for size, n in many.items():
        turn = F.pmod(F.xxhash64("key", F.lit(_SEEDED)), F.lit(1 << 30)) / float(1 << 30)
        drawn = classes.where((F.size("vector") == size) & (turn < min(1.0, SAMPLE / n))).select("vector").orderBy("vector").toPandas()
        models[size] = learn_model(_unit(np.array(drawn["vector"].tolist() or [np.ones(size)])), n, similarity)
    coded = classes.select("key", "space", "vector").mapInArrow(_encoder(models), "key binary, space string, code long, node binary, bits int, turn int, radius int")
    coded = scratch.store(coded)
    nodes = coded.select("node", "space", "code", "bits", "turn", "radius").distinct()
    probes = nodes.mapInArrow(_probes(sum(many.values())), "grp long, key binary, code long, radius int, home boolean")
    probes = scratch.store(probes)
    near = compare_in_groups(probes, _near_codes, scratch, gather="none", useful=F.max("home"))
    near = near.select("a", "b")
    first = coded.where("turn = 0")
    if any(len(m.projections) > 1 for m in models.values()):  # the codes of a vector belong together
        near = near.union(first.select("key", F.col("node").alias("a")).join(coded.where("turn > 0").select("key", F.col("node").alias("b")), "key").select("a", "b"))
    groups = components(near, scratch)
    scratch.drop(probes)

    placed = first.select("key", "node").join(groups, "node", "left").select("key", F.coalesce("root", "node").alias("grp"))
    members = scratch.store(classes.select("key", "n", "vector").join(placed, "key"))
    found = resolve(compare_in_groups(members, _near_vectors(similarity), scratch), scratch)
    known = classes.select("key", "n", "first").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = scratch.store(known.select("key", "root", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = scratch.store(known.groupBy("root").agg(F.min("first").alias("component_id")))
    known = scratch.store(known.join(least, "root").select("key", "n_links", "component_id"))
    out = keyed.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

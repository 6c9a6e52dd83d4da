"""Bayesian voxel selection fitted by Gibbs sampling, on Spark.

What grows with the subjects stays distributed: a chunk of subjects is one row
with its images as a matrix, and chunks never move once they are laid out.
What is parameter-sized is one packed row per (replicate, chain). A job is a
pass over the chunks, whose partial sums Spark adds up in bands, and a step
per (replicate, chain) that turns the sums into the next state.

One iteration: z, theta of all voxels in order, alpha, radius, delta of all
voxels in order, inclusion map, tau and 1/a.

* Residuals. A pass keeps z and the predictor of its subjects, one small row
  per chunk beside the images. A step lists the coefficients it moved, and the
  next pass moves the predictors by these alone. No predictor is built anew.
* theta needs the Gram matrix of a group of selected voxels and the products
  of their basis with the residual. The basis never changes, so Gram tiles of
  two voxels are summed over the subjects once, when a voxel is selected for
  the first time by any chain, and read from a table afterwards.
* delta: a voxel's log-odds depend on its effect column f = B theta alone, so
  a delta job needs the Gram matrix of the effects of a block of voxels: one
  column per voxel instead of one per basis function.

The size of groups, blocks and chunks is layout: it changes how many jobs there
are, never a draw. Every pass and step ends in a table in the shared folder;
superseded ones are deleted. After each iteration a mark commits its tables: a
fit that was stopped goes on behind the last mark (``resume_fit``) and returns
the draws of an unbroken run.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.functions.counter import counter_uniforms, id_uniforms, stream
from voxelfield.functions.gamma import gamma_draw
from voxelfield.functions.hermite import basis_array
from voxelfield.functions.keyed import keyed_normals, keyed_uniform, keys, uniforms
from voxelfield.functions.normal import EPSILON, norm_cdf_array, norm_ppf, norm_ppf_array, positive_normal_array
from voxelfield.operators import posterior
from voxelfield.operators.additive import log_posterior_column
from voxelfield.operators.inclusion import window_means
from voxelfield.operators.joins import voxel_join
from voxelfield.operators.ranking import range_cuts, row_numbers
from voxelfield.session import drop_folder, file_names, shared_dir, touch

FIT = ["replicate", "chain_id"]
SCALARS = ["alpha", "inv_sigma_sq", "inv_a"]

# Bytes of the sums that all chains of a replicate send from one task.
GRAM_BYTES = 64 * 1024 * 1024
MOST_COLUMNS = 2048
# Basis columns of a group of voxels whose coefficients one step moves.
GROUP_COLUMNS = 4200
# Doubles one chunk of subjects may hold (images, or the basis of a few voxels). A worker holds a few times as much.
CHUNK_DOUBLES = 1_000_000
# Wide images make a chunk larger, so that the states sent along with it serve some subjects.
FEWEST_SUBJECTS, WIDE_DOUBLES = 16, 4_000_000
# Chunks that a task of a pass adds up, where the session has not more partitions than these need.
CHUNKS_PER_TASK = 8
# Doubles per band of a sum on its way to a step; a band's sums of all tasks are added in one place.
BAND = 1 << 14
# Positions whose tiles share a folder, and how many tables of tiles there are before they are made one.
SHELF = 64
MOST_FILLS = 16
# Rows of the trace that a state carries at most.
TRACE_ROWS = 256


@dataclass(frozen=True)
class FitConfig:
    degree: int = 20
    a: float = 0.01
    b: float = 100.0
    burnin: int = 5000
    mcmc_sample: int = 500
    thinning: int = 10
    chains: int = 1
    seed: int = 0
    radii: tuple[int, ...] = (1,)
    radius_update_thinning: int = 1
    prior_min: float = 0.0
    prior_max: float = 1.0
    initial_sigma_sq: float = 1.0
    initial_a: float | None = None
    rule: str = "bernoulli"
    tau_cap: float | None = None
    update_theta: bool = True
    update_alpha: bool = True
    update_delta: bool = True
    update_z: bool = True
    update_sigma: bool = True
    update_a: bool = True
    keep_latent: bool = False
    keep_burnin: bool = False
    trace_every: int = 1
    block_voxels: int | None = None

    @property
    def n_basis(self) -> int:
        return self.degree + 1

    @property
    def total_iter(self) -> int:
        """Iterations run from 0; the last is the last draw kept."""
        return self.burnin + self.mcmc_sample * self.thinning + 1

    def retained(self, iteration: int) -> bool:
        after = iteration - self.burnin
        return after > 0 and after % self.thinning == 0


@dataclass(frozen=True)
class Fit:
    """Retained draws (with ``keep_burnin`` those of every iteration) and the trace, as written tables."""

    voxel: DataFrame
    scalar: DataFrame
    subject: DataFrame | None
    path: str


class _Store:
    """Numbered tables and marks below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, df: DataFrame, name: str, number: int | None = None, by: str | None = None) -> DataFrame:
        path = self.where(name, number)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.load(name, number, df.schema)

    def load(self, name: str, number: int | None = None, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.where(name, number))

    def where(self, name: str, number: int | None = None) -> str:
        return os.path.join(self.path, name, *([] if number is None else [f"iter={number}"]))

    def numbers(self, name: str) -> list[int]:
        """Which tables of a name were written in full."""
        found = [int(f.split("=")[1]) for f in file_names(self.spark, self.where(name)) if f.startswith("iter=")]
        return sorted(n for n in found if "_SUCCESS" in file_names(self.spark, self.where(name, n)))

    def all_iterations(self, name: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
        """Rows of every table of a name, none if there is none."""
        numbers = self.numbers(name) if numbers is None else numbers
        if not numbers:
            return self.spark.createDataFrame([], f"{schema}, iter int")
        reader = self.spark.read.schema(f"{schema}, iter int").option("basePath", self.where(name))
        return reader.parquet(*[self.where(name, n) for n in numbers])

    def drop(self, name: str, number: int | None = None) -> None:
        drop_folder(self.spark, self.where(name, number))

    def mark(self, *numbers: int) -> None:
        """Commit: a mark names an iteration and the tables it ends with."""
        touch(self.spark, os.path.join(self.where("commits"), ",".join(str(n) for n in numbers)))

    def last_mark(self) -> tuple[int, ...] | None:
        marks = [tuple(int(n) for n in name.split(",")) for name in file_names(self.spark, self.where("commits"))]
        return max(marks, default=None)


def _keyed(df: DataFrame) -> DataFrame:
    return df if "replicate" in df.columns else df.withColumn("replicate", F.lit(0))


def _safe_basis(x: np.ndarray, config: FitConfig) -> np.ndarray:
    """Basis of an array of values; an absent voxel (NaN) has no effect."""
    out = basis_array(np.nan_to_num(x), config.degree, config.a, config.b)
    out[np.isnan(x)] = 0.0
    return out


# The packed state of one (replicate, chain)

# Arrays of a state and their types; sizes follow from the voxels, the basis and the partitions.
ARRAYS = {
    "voxel_id": np.int32, "open": np.bool_, "part": np.int32, "place": np.int32, "edges": np.int32,
    "delta": np.int8, "theta": np.float64, "p": np.float64, "candidates": np.float64, "radius": np.int32,
    # Voxels with Gram tiles, those of them that came last, where groups start, the coefficients moved by the last step.
    "known": np.bool_, "learned": np.int32, "cuts": np.int32, "moved": np.int32, "moved_by": np.float64, "trace": np.float64,
}
NUMBERS = ["alpha", "inv_sigma_sq", "inv_a", "loglik"]
STATE = "replicate int, chain_id int, " + ", ".join([f"{a} binary" for a in ARRAYS] + [f"{n} double" for n in NUMBERS]) + ", fresh int, groups int"
TRACE = ["iter", *SCALARS, "theta_sq", "loglik"]


def _state_row(replicate: int, chain: int, state: dict) -> pa.Table:
    columns = {"replicate": pa.array([replicate], pa.int32()), "chain_id": pa.array([chain], pa.int32())}
    columns |= {a: pa.array([np.ascontiguousarray(state[a], dtype=t).tobytes()], pa.binary()) for a, t in ARRAYS.items()}
    columns |= {n: pa.array([float(state[n])], pa.float64()) for n in NUMBERS}
    columns["fresh"] = pa.array([len(_fresh(state))], pa.int32())
    columns["groups"] = pa.array([len(state["cuts"]) - 1], pa.int32())
    return pa.table(columns)


def _state(row: dict, n_basis: int) -> dict:
    state = {a: np.frombuffer(row[a], dtype=t).copy() for a, t in ARRAYS.items()} | {n: row[n] for n in NUMBERS}
    voxels = len(state["voxel_id"])
    for name in ("theta", "moved_by"):
        state[name] = state[name].reshape(-1, n_basis)
    state["trace"] = state["trace"].reshape(-1, len(TRACE))
    if len(state["place"]):
        state["candidates"] = state["candidates"].reshape(voxels, -1)
        state["place"] = state["place"].reshape(voxels, 2)
    state["edges"] = state["edges"].reshape(-1, 2)
    return state


def _fresh(state: dict) -> np.ndarray:
    """Selected voxels without Gram tiles."""
    return np.flatnonzero((state["delta"] == 1) & state["open"] & ~state["known"])


def _map(state: dict, config: FitConfig) -> None:
    """The inclusion map of a state, and on a lattice the maps of all candidate radii.

    As ``operators.inclusion``: window means without excluded cells (0.5 at
    radius 0) or neighbour means, scaled to the prior's range.
    """
    delta = state["delta"].astype(float)
    if len(state["place"]):
        everywhere = np.ones(len(delta), dtype=bool)
        state["candidates"] = np.stack([window_means(state["place"], delta, everywhere, r) for r in config.radii], axis=1)
        own = state["radius"][state["part"]]
        p = np.full(len(delta), np.nan)
        for r in np.unique(own):
            p[own == r] = 0.5 if r == 0 else window_means(state["place"], delta, state["open"], r)[own == r]
    else:
        source, target = state["edges"].T
        hits = np.bincount(source, weights=delta[target], minlength=len(delta))
        with np.errstate(invalid="ignore", divide="ignore"):
            p = hits / np.bincount(source, minlength=len(delta))
    state["p"] = p * (config.prior_max - config.prior_min) + config.prior_min


# Layout


def _chunk_count(people: int, top: int, config: FitConfig, cores: int) -> int:
    """Chunks of a replicate's subjects, whose images have ``top`` voxels at most."""
    width = max(top, config.n_basis)
    per_chunk = max(1, CHUNK_DOUBLES // width, min(FEWEST_SUBJECTS, WIDE_DOUBLES // width))
    return max(math.ceil(people / per_chunk), min(cores, math.ceil(people / 64)))


def _positions(voxels: DataFrame) -> DataFrame:
    """(replicate, voxel_id, position): ids of any size become 0, 1, ... per replicate."""
    ranked = row_numbers(voxels.select("replicate", "voxel_id"), ["replicate"], "voxel_id", range_cuts(voxels, "voxel_id"), "position")
    return ranked.withColumn("position", (F.col("position") - 1).cast("int"))


def _chunks(images: DataFrame, labels: DataFrame, voxels: DataFrame, sizes: DataFrame, chunks: int) -> DataFrame:
    """One row per chunk of subjects: ids, outcomes, starting z and images as a matrix.

    Excluded and absent voxels are NaN. A subject without any kept cell stays,
    its predictor is alpha. Subjects are spread over chunks by hash. ``key`` is
    the number that names a subject's draws: its id, or a hash of an id that is
    no integer.
    """
    kept = voxels.where(~F.col("excluded")).select("replicate", "voxel_id", "position")
    cells = voxel_join(images, kept, ["replicate", "voxel_id"], row_bytes=48)
    per_subject = cells.groupBy("replicate", "subject_id").agg(F.collect_list(F.struct("position", F.col("value").cast("double").alias("value"))).alias("c"))
    z0 = F.col("z").cast("double") if "z" in labels.columns else F.lit(0.0)
    whole = labels.schema["subject_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col("subject_id").cast("long") if whole else F.xxhash64("subject_id")
    staged = labels.select("replicate", "subject_id", key.alias("key"), F.col("y").cast("int").alias("y"), z0.alias("z0")).join(
        per_subject, ["replicate", "subject_id"], "left"
    ).join(F.broadcast(sizes), "replicate")
    staged = staged.select(
        F.col("replicate").cast("int"), F.pmod(F.xxhash64("subject_id"), F.lit(chunks)).cast("int").alias("chunk_id"),
        F.col("subject_id").cast("string"), "key", "y", "z0", "voxels",
        F.coalesce("c.position", F.array().cast("array<int>")).alias("v"), F.coalesce("c.value", F.array().cast("array<double>")).alias("x"),
    )

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("subject_id")
        image = np.full((rows.num_rows, rows.column("voxels")[0].as_py()), np.nan)
        for i, (v, x) in enumerate(zip(rows.column("v"), rows.column("x"))):
            image[i, np.asarray(v.values)] = np.asarray(x.values)
        return pa.table({
            "replicate": rows.column("replicate").slice(0, 1), "chunk_id": rows.column("chunk_id").slice(0, 1),
            "subject_id": pa.array([rows.column("subject_id").to_pylist()], pa.list_(pa.string())),
            "key": pa.array([np.asarray(rows.column("key"), dtype=np.int64).tobytes()], pa.binary()),
            "y": pa.array([np.asarray(rows.column("y")).astype(np.int8).tobytes()], pa.binary()),
            "z0": pa.array([np.asarray(rows.column("z0"), dtype=np.float64).tobytes()], pa.binary()),
            "image": pa.array([image.tobytes()], pa.binary()),
        })

    return staged.groupBy("replicate", "chunk_id").applyInArrow(pack, LAYOUT)


LAYOUT = "replicate int, chunk_id int, subject_id array<string>, key binary, y binary, z0 binary, image binary"


class _Chunk:
    """Subjects of one row, with what a pass needs of them; z and eta have a column per chain."""

    def __init__(self, row: dict, config: FitConfig, chains: int):
        self.config, self.replicate = config, row["replicate"]
        self.keys, self.y = np.frombuffer(row["key"], np.int64), np.frombuffer(row["y"], np.int8)
        self.z0 = np.frombuffer(row["z0"], np.float64)
        self.image = np.frombuffer(row["image"], np.float64).reshape(len(self.y), -1)
        shape = (len(self.y), chains)
        # Before the first pass nothing is known: z starts as given, the predictors at zero.
        self.z = np.repeat(self.z0[:, None], chains, axis=1) if row["z"] is None else np.frombuffer(row["z"], np.float64).reshape(shape)
        self.eta = np.zeros(shape) if row["eta"] is None else np.frombuffer(row["eta"], np.float64).reshape(shape).copy()
        # Voxels whose basis is held at once.
        self.some = max(1, CHUNK_DOUBLES // (len(self.y) * config.n_basis))

    def parts(self, voxels: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The basis (subjects, voxels, n_basis) of a few voxels at a time."""
        for at in range(0, len(voxels), self.some):
            yield slice(at, at + self.some), _safe_basis(self.image[:, voxels[at : at + self.some]], self.config)

    def move(self, states: dict[int, dict]) -> None:
        """Predictors follow the coefficients that the last step moved."""
        voxels = np.unique(np.concatenate([s["moved"] for s in states.values()]))
        weights = np.zeros((len(voxels), self.config.n_basis, len(states)))
        for c, s in enumerate(states.values()):
            weights[np.searchsorted(voxels, s["moved"]), :, c] = s["moved_by"]
        for part, basis in self.parts(voxels):
            flat = basis.reshape(len(self.y), -1)
            self.eta += flat @ weights[part].reshape(flat.shape[1], -1)

    def draw_latent(self, eta: np.ndarray, chains: list[int], iteration: int) -> None:
        """z of all subjects and chains from the predictors the iteration starts from."""
        side = np.where(self.y == 1, 1.0, -1.0)[:, None]
        u = np.stack([id_uniforms(stream(self.config.seed, "z", iteration, self.replicate, c), self.keys) for c in chains], axis=1)
        self.z = side * positive_normal_array(side * eta, u)

    def loglik(self, eta: np.ndarray) -> np.ndarray:
        cdf, y = norm_cdf_array(eta), self.y[:, None]
        return (y * np.log(cdf + EPSILON) + (1 - y) * np.log(1 - cdf + EPSILON)).sum(axis=0)


@dataclass(frozen=True)
class _Job:
    """One pass and step: ``kind`` theta or delta, the number of its group or block of voxels."""

    kind: str
    number: int
    block: int
    iteration: int
    given_z: bool
    radius: bool = False
    last: bool = False
    trim: bool = False
    still: bool = False

    @property
    def first(self) -> bool:
        return self.kind == "theta" and self.number == 0

    def voxels(self, state: dict, config: FitConfig) -> np.ndarray:
        """Positions this job moves: a group's selected voxels for theta, a block of open ones for delta."""
        if self.kind == "theta":
            if not config.update_theta or self.still or self.number >= len(state["cuts"]) - 1:
                return np.zeros(0, np.int64)
            low, high = state["cuts"][self.number : self.number + 2]
            return low + np.flatnonzero((state["delta"][low:high] == 1) & state["open"][low:high])
        if not config.update_delta:
            return np.zeros(0, np.int64)
        return np.flatnonzero(state["open"])[self.number * self.block : (self.number + 1) * self.block]


def _products(job: _Job, chunk: _Chunk, states: dict[int, dict], config: FitConfig) -> Iterator[tuple[int, np.ndarray]]:
    """Per chain the sums of one chunk, as one vector: totals, radius misses, products, and by kind column sums or half the Gram matrix."""
    chains = list(states)
    chunk.move(states)
    eta = np.array([s["alpha"] for s in states.values()]) + chunk.eta
    loglik = np.zeros(len(chains))
    if job.first:
        loglik = chunk.loglik(eta)
        if not job.given_z:
            chunk.draw_latent(eta, chains, job.iteration)
    rest = chunk.z - eta
    for c, (chain, state) in enumerate(states.items()):
        own = job.voxels(state, config)
        misses = _radius_misses(chunk, state, chunk.z[:, c], config) if job.radius else np.zeros(0)
        totals = [np.array([rest[:, c].sum(), float(len(rest)), loglik[c]]), misses]
        if job.kind == "theta":
            products, columns = np.zeros(len(own) * config.n_basis), np.zeros(len(own) * config.n_basis)
            for part, basis in chunk.parts(own):
                flat, at = basis.reshape(len(rest), -1), slice(part.start * config.n_basis, part.stop * config.n_basis)
                products[at], columns[at] = flat.T @ rest[:, c], flat.sum(axis=0)
            yield chain, np.concatenate([*totals, products, columns])
        else:
            effects = np.empty((len(rest), len(own)))
            for part, basis in chunk.parts(own):
                effects[:, part] = np.einsum("nvl,vl->nv", basis, state["theta"][own[part]])
            gram = effects.T @ effects
            yield chain, np.concatenate([*totals, effects.T @ rest[:, c], gram[np.tril_indices(len(gram))]])


def _radius_misses(chunk: _Chunk, state: dict, z: np.ndarray, config: FitConfig) -> np.ndarray:
    """Squared misses per partition and candidate radius, the candidate's map in place of the partition's own.

    A candidate's columns exist for the voxels of its partition only.
    """
    p = np.nan_to_num(state["p"], nan=0.5)
    parts, radii = len(state["radius"]), len(config.radii)
    order = np.flatnonzero(state["open"])
    order = order[np.argsort(state["part"][order], kind="stable")]
    base, shifts = z - state["alpha"], np.zeros((parts, len(z), radii))
    for part, basis in chunk.parts(order):
        voxels = order[part]
        effects = np.einsum("nvl,vl->nv", basis, state["theta"][voxels])
        base = base - effects @ p[voxels]
        for name in np.unique(state["part"][voxels]):
            here = state["part"][voxels] == name
            shifts[name] += effects[:, here] @ (state["candidates"][voxels[here]] - p[voxels[here], None])
    return ((base[None, :, None] - shifts) ** 2).sum(axis=1).ravel()


PASS = "kind int, replicate int, chunk_id int, chain_id int, band int, sums binary, z binary, eta binary"


def _with_states(rows: DataFrame, states: DataFrame, config: FitConfig, state_bytes: int) -> DataFrame:
    """Rows of chunks with the states of their replicate's chains, which travel as one row, broadcast when they are proven to fit."""
    fields = ["chain_id", *ARRAYS, *NUMBERS]
    packed = states.groupBy("replicate").agg(F.collect_list(F.struct(*fields)).alias("chains"))
    return voxel_join(rows, packed, ["replicate"], row_bytes=state_bytes * config.chains)


def _read_states(batch: pa.RecordBatch, i: int, config: FitConfig) -> dict[int, dict]:
    rows = sorted(batch.column("chains")[i].as_py(), key=lambda s: s["chain_id"])
    return {s["chain_id"]: _state(s, config.n_basis) for s in rows}


def _bands(kind: int, keys: tuple[int, int], vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for band in range(max(1, -(-len(vector) // BAND))):
        part = vector[band * BAND : (band + 1) * BAND]
        yield _pass_row(kind, keys[0], None, keys[1], band, part.tobytes(), None, None)


def _pass_row(*values) -> pa.RecordBatch:
    types = [pa.int32()] * 5 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[f.split()[0] for f in PASS.split(", ")])


CHUNK_COLUMNS = ("replicate", "chunk_id", "key", "y", "z0", "image", "z", "eta")


def _pass(layout: DataFrame, residual: DataFrame, states: DataFrame, job: _Job, config: FitConfig, state_bytes: int) -> DataFrame:
    """The job's sums per task and chain (kind 0), and z and predictor of every chunk (kind 1).

    Chunks stay where they are; their last residuals come to them. A task adds
    up its chunks before it hands anything on.
    """
    rows = layout.drop("subject_id").join(residual.hint("shuffle_hash"), ["replicate", "chunk_id"], "left")
    rows = _with_states(rows, states, config, state_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, states_of = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in CHUNK_COLUMNS if c != "image"}
                row["image"] = batch.column("image")[i].as_buffer()
                if row["replicate"] != held:
                    for chain, vector in sums.items():
                        yield from _bands(0, (held, chain), vector)
                    held, sums, states_of = row["replicate"], {}, _read_states(batch, i, config)
                chunk = _Chunk(row, config, len(states_of))
                for chain, vector in _products(job, chunk, states_of, config):
                    sums[chain] = sums[chain] + vector if chain in sums else vector
                yield _pass_row(1, held, row["chunk_id"], None, None, None, chunk.z.tobytes(), chunk.eta.tobytes())
        for chain, vector in sums.items():
            yield from _bands(0, (held, chain), vector)

    return rows.mapInArrow(run, PASS)


def _total(sums: pa.ChunkedArray) -> np.ndarray:
    """The sum of vectors of doubles, which are read where they lie."""
    total = None
    for vector in sums:
        vector = np.frombuffer(vector.as_buffer(), np.float64)
        if total is None:
            total = vector.copy()
        else:
            total += vector
    return total


def _added(sums: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Sums of equal keys added up."""

    def add(rows: pa.Table) -> pa.Table:
        total = _total(rows.column("sums"))
        at = rows.schema.get_field_index("sums")
        return rows.slice(0, 1).set_column(at, "sums", pa.array([total.tobytes()], pa.binary()))

    return sums.groupBy(*keys).applyInArrow(add, schema)


# Gram tiles

TILES = "shelf int, replicate int, v int, w int, tile binary"


def _strips(layout: DataFrame, states: DataFrame, part: slice, config: FitConfig, state_bytes: int) -> DataFrame:
    """Gram tiles (v, w), w <= v, of the voxels learned last with the known voxels of their group.

    ``part`` says which of them; the one learned later brings a pair's tile.
    """
    rows = _with_states(layout.select("replicate", "image"), states, config, state_bytes)
    size = config.n_basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, pairs = None, {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            for v, total in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held], pa.int32()), pa.array([v], pa.int32()), pa.array([pairs[v].astype(np.int32).tobytes()], pa.binary()),
                     pa.array([total.tobytes()], pa.binary())],
                    names=["replicate", "v", "others", "sums"],
                )

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("replicate")[i].as_py() != held:
                    yield from out()
                    held, sums = batch.column("replicate")[i].as_py(), {}
                    state = next(iter(_read_states(batch, i, config).values()))
                    pairs, wide = _pairs(state, part), len(state["voxel_id"])
                image = np.frombuffer(batch.column("image")[i].as_buffer(), np.float64).reshape(-1, wide)
                some = max(1, CHUNK_DOUBLES // (len(image) * size))
                for v, others in pairs.items():
                    own = _safe_basis(image[:, [v]], config).reshape(len(image), -1)
                    total = np.empty((len(others), size, size))
                    for at in range(0, len(others), some):
                        theirs = _safe_basis(image[:, others[at : at + some]], config).reshape(len(image), -1)
                        total[at : at + some] = (theirs.T @ own).reshape(-1, size, size)
                    sums[v] = sums[v] + total if v in sums else total
        yield from out()

    def open_strip(rows: pa.Table) -> pa.Table:
        total = _total(rows.column("sums")).reshape(-1, size, size)
        v, others = rows.column("v")[0].as_py(), np.frombuffer(rows.column("others")[0].as_py(), np.int32)
        high, low = np.maximum(others, v), np.minimum(others, v)
        tiles = [(t.T if v >= w else t).tobytes() for w, t in zip(others, total)]  # rows belong to the higher voxel
        return pa.table({
            "shelf": pa.array(high // SHELF, pa.int32()), "replicate": pa.array([rows.column("replicate")[0].as_py()] * len(others), pa.int32()),
            "v": pa.array(high, pa.int32()), "w": pa.array(low, pa.int32()), "tile": pa.array(tiles, pa.binary()),
        })

    strips = rows.mapInArrow(run, "replicate int, v int, others binary, sums binary")
    return strips.groupBy("replicate", "v").applyInArrow(open_strip, TILES)


def _pairs(state: dict, part: slice) -> dict[int, np.ndarray]:
    """For some of the voxels learned last, the voxels of their group whose tiles with them are missing."""
    known, cuts, learned = np.flatnonzero(state["known"]), state["cuts"], state["learned"]
    old = np.setdiff1d(known, learned)
    out = {}
    for v in learned[part]:
        group = np.searchsorted(cuts, v, side="right") - 1
        low, high = cuts[group], cuts[group + 1]
        out[int(v)] = np.concatenate([old[(old >= low) & (old < high)], learned[(learned >= low) & (learned <= v)]])
    return out


def _learn(states: list[dict], most: int) -> None:
    """Voxels selected for the first time become known ones in all chains; groups that have grown too large are cut."""
    known = states[0]["known"].copy()
    learned = np.unique(np.concatenate([_fresh(s) for s in states]))
    known[learned] = True
    cuts = _cut(known, states[0]["cuts"], most)
    for state in states:
        state["known"], state["learned"], state["cuts"] = known, learned, cuts


def _cut(known: np.ndarray, cuts: np.ndarray, most: int) -> np.ndarray:
    """Group starts (and the end) such that no group has more than ``most`` known voxels; old ones stay."""
    out = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        own = low + np.flatnonzero(known[low:high])
        pieces = max(1, -(-len(own) // most))
        out += [low, *(own[len(own) * k // pieces] for k in range(1, pieces))]
    return np.array([*out, cuts[-1]], dtype=np.int32)


def _learned(states: DataFrame, config: FitConfig, most: int) -> DataFrame:
    """States after ``_learn``, replicate by replicate."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        old = sorted(rows.to_pylist(), key=lambda s: s["chain_id"])
        opened = [_state(s, config.n_basis) for s in old]
        _learn(opened, most)
        return pa.concat_tables([_state_row(s["replicate"], s["chain_id"], o) for s, o in zip(old, opened)])

    return states.groupBy("replicate").applyInArrow(work, STATE)


def _chosen(states: DataFrame, job: _Job, config: FitConfig) -> DataFrame:
    """(replicate, chain_id, v): voxels whose coefficients a theta job moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = job.voxels(_state(row, config.n_basis), config)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), row[k], np.int32)) for k in FIT] + [pa.array(own.astype(np.int32))], names=[*FIT, "v"]
                )

    return states.mapInArrow(run, "replicate int, chain_id int, v int")


def _tiles_of(tiles: DataFrame, states: DataFrame, job: _Job, config: FitConfig) -> DataFrame:
    """The tiles of every chain's pairs of chosen voxels; of those there are at most a group's per chain."""
    chosen = _chosen(states, job, config)
    rows = tiles.join(F.broadcast(chosen), ["replicate", "v"])
    return rows.join(F.broadcast(chosen.withColumnRenamed("v", "w")), [*FIT, "w"]).select(*FIT, "v", "w", "tile")


# Steps


def _theta_step(job: _Job, state: dict, sums: np.ndarray, tiles: list, config: FitConfig, key: str) -> None:
    """Move theta of the group's selected voxels in order, of all others by their prior, and alpha after the last group."""
    size, own = config.n_basis, job.voxels(state, config)
    rest_sum, subjects, loglik = sums[:3]
    m = len(own) * size
    c, colsum = sums[3 : 3 + m].copy(), sums[3 + m : 3 + 2 * m]
    g = _gram(own, tiles, size)
    tau, theta, ids = state["inv_sigma_sq"], state["theta"], state["voxel_id"]
    name = stream(config.seed, "theta", job.iteration, key)
    normals = lambda voxels: norm_ppf_array(counter_uniforms(name, ids[voxels][:, None], np.arange(size)))
    state["moved"], state["moved_by"] = np.zeros(0, np.int32), np.zeros((0, size))
    if job.first:
        state["loglik"] = loglik
        if len(state["trace"]):
            state["trace"][-1, -1] = loglik if state["trace"][-1, 0] == job.iteration - 1 else state["trace"][-1, -1]
        if job.trim:
            state["trace"] = state["trace"][-1:]
        if config.update_theta and not job.still:
            prior = np.flatnonzero(state["open"] & (state["delta"] == 0))
            theta[prior] = normals(prior) / math.sqrt(tau)
    if len(own):
        before, noise = theta[own].copy(), normals(own)
        for i, v in enumerate(own):
            at = slice(i * size, (i + 1) * size)
            root = np.linalg.cholesky(g[at, at] + tau * np.eye(size))
            centre = np.linalg.solve(root, c[at] + g[at, at] @ theta[v]) + noise[i]
            change = np.linalg.solve(root.T, centre) - theta[v]
            c -= change @ g[at]
            rest_sum -= colsum[at] @ change
            theta[v] += change
        state["moved"], state["moved_by"] = own.astype(np.int32), theta[own] - before
    if config.update_alpha and not job.still and job.number == max(0, len(state["cuts"]) - 2):
        weight = subjects + tau
        replicate, chain = key.split("|")
        normal = float(norm_ppf_array(uniforms(f"{config.seed}|alpha|{job.iteration}|{replicate}", [chain]))[0])
        state["alpha"] = (rest_sum + subjects * state["alpha"]) / weight + normal / math.sqrt(weight)


def _gram(own: np.ndarray, tiles: list, size: int) -> np.ndarray:
    """Gram matrix of the basis of voxels ``own`` from tiles (v, w, bytes), v >= w."""
    g = np.zeros((len(own), size, len(own), size))
    if len(tiles) != len(own) * (len(own) + 1) // 2:
        raise ValueError(f"{len(tiles)} Gram tiles for {len(own)} voxels")
    place = {int(v): i for i, v in enumerate(own)}
    for v, w, data in tiles:
        tile, i, j = np.frombuffer(data, np.float64).reshape(size, size), place[v], place[w]
        g[i, :, j] = tile
        g[j, :, i] = tile.T
    return g.reshape(len(own) * size, len(own) * size)


def _delta_step(job: _Job, state: dict, sums: np.ndarray, config: FitConfig, key: str) -> None:
    """Radius (with the first block), then delta of the block's voxels in order."""
    at = 3
    state["moved"], state["moved_by"] = np.zeros(0, np.int32), np.zeros((0, config.n_basis))
    if job.radius:
        n = len(state["radius"]) * len(config.radii)
        best = sums[at : at + n].reshape(len(state["radius"]), -1).argmin(axis=1)  # the first on ties
        state["radius"] = np.array(config.radii, dtype=np.int32)[best]
        at += n
    own = job.voxels(state, config)
    m = len(own)
    if not m:
        return
    c, g = sums[at : at + m].copy(), _full(sums[at + m :], m)
    u = id_uniforms(stream(config.seed, "delta", job.iteration, key), state["voxel_id"][own])
    p = np.nan_to_num(state["p"][own], nan=0.5)
    prior = np.log((1 - p + EPSILON) / (p + EPSILON))
    before = state["delta"][own].astype(np.int64)
    for i, v in enumerate(own):
        old = int(before[i])
        against = 0.5 * g[i, i] - (c[i] + old * g[i, i]) + prior[i]
        chance = 1.0 / (1.0 + math.exp(min(against, 700.0)))
        fresh = int(chance >= 0.5) if config.rule == "map" else int(u[i] < chance)
        if fresh != old:
            c -= (fresh - old) * g[i]
            state["delta"][v] = fresh
    change = state["delta"][own] - before
    moved = change != 0
    state["moved"], state["moved_by"] = own[moved].astype(np.int32), change[moved, None] * state["theta"][own[moved]]


def _closing_step(job: _Job, state: dict, config: FitConfig, key: str) -> None:
    """Inclusion map, tau and 1/a; the state becomes the start of the next iteration."""
    _map(state, config)
    theta_sq = float((state["theta"] ** 2).sum())
    replicate, chain = key.split("|")
    if config.update_sigma:
        rate = state["inv_a"] + 0.5 * theta_sq + 0.5 * state["alpha"] ** 2
        tau = gamma_draw(f"{config.seed}|tau|{job.iteration}|{key}", 0.5 * state["theta"].size + 1) / rate
        state["inv_sigma_sq"] = tau if config.tau_cap is None else min(tau, config.tau_cap)
    if config.update_a:
        u = uniforms(f"{config.seed}|inv_a|{job.iteration}|{replicate}", [chain])[0]
        state["inv_a"] = -math.log(u) / (state["inv_sigma_sq"] + 1.0)
    if job.iteration % config.trace_every == 0:
        row = [job.iteration, *(state[s] for s in SCALARS), theta_sq, np.nan]
        state["trace"] = np.vstack([state["trace"], row])


def _full(half: np.ndarray, n: int) -> np.ndarray:
    """Symmetric matrix from its lower half."""
    out = np.zeros((n, n))
    low = np.tril_indices(n)
    out[low] = half
    out.T[low] = half
    return out


STEP_INPUT = "replicate int, chain_id int, band int, v int, w int, data binary"


def _step(states: DataFrame, sums: DataFrame, tiles: DataFrame | None, job: _Job, config: FitConfig) -> DataFrame:
    """The state of every (replicate, chain) after the job."""
    none = F.lit(None).cast("int")
    added = _added(sums.select(*FIT, "band", "sums"), [*FIT, "band"], "replicate int, chain_id int, band int, sums binary")
    rows = added.select(*FIT, "band", none.alias("v"), none.alias("w"), F.col("sums").alias("data"))
    if tiles is not None:
        rows = rows.unionByName(tiles.select(*FIT, none.alias("band"), "v", "w", F.col("tile").alias("data")))

    def work(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        replicate, chain = (k.as_py() for k in key)
        state = _state(old.to_pylist()[0], config.n_basis)
        given = list(zip(*(new.column(c).to_pylist() for c in ("band", "v", "w", "data"))))
        total = np.concatenate([np.frombuffer(d, np.float64) for _, d in sorted((b, d) for b, v, w, d in given if b is not None)])
        name = f"{replicate}|{chain}"
        if job.kind == "theta":
            _theta_step(job, state, total, [(v, w, d) for b, v, w, d in given if b is None], config, name)
        else:
            _delta_step(job, state, total, config, name)
        if job.last:
            _closing_step(job, state, config, name)
        return _state_row(replicate, chain, state)

    return states.groupBy(*FIT).cogroup(rows.groupBy(*FIT)).applyInArrow(work, STATE)


# Start


def _start(voxels: DataFrame, edges: DataFrame | None, initial: DataFrame | None, config: FitConfig) -> DataFrame:
    """Starting states, one packed row per replicate and chain.

    ``initial`` gives delta, theta and alpha, and p if it has such a column;
    else all are drawn and the map follows from delta, moved off 0 and 1.
    """
    chains = F.explode(F.sequence(F.lit(0), F.lit(config.chains - 1))).alias("chain_id")
    base = voxels.select("*", chains)
    voxel_key, per_chain = keys(*FIT, "voxel_id"), keys(*FIT)
    if initial is None:
        rows = base.withColumns({
            "delta": (keyed_uniform(config.seed, "delta0", *voxel_key) < 0.5).cast("int"),
            "theta": keyed_normals(config.n_basis, config.seed, "theta0", *voxel_key),
            "__u": keyed_uniform(config.seed, "alpha0", *per_chain),
        }).withColumn("alpha", norm_ppf("__u"))
    else:
        shared = [k for k in FIT if k in initial.columns]
        given = [c for c in ("delta", "theta", "alpha", "p") if c in initial.columns]
        rows = base.join(initial.select(*shared, "voxel_id", *given), [*shared, "voxel_id"], "left")
    rows = rows.withColumn("__a", keyed_uniform(config.seed, "a0", *per_chain))
    root = norm_ppf("__a")
    rows = rows.withColumn("inv_a", root * root / 2.0 if config.initial_a is None else F.lit(1.0 / config.initial_a))
    if "p" not in rows.columns:
        rows = rows.withColumn("p", F.lit(None).cast("double"))
    on_lattice = edges is None
    place = [F.col("row").cast("int"), F.col("col").cast("int")] if on_lattice else []
    rows = rows.select(
        *FIT, "voxel_id", "position", "excluded", F.col("partition_id").cast("long"), F.col("delta").cast("int"),
        F.col("theta").cast("array<double>"), F.col("alpha").cast("double"), "p", "inv_a", *place,
    )
    if on_lattice:
        links = rows.sparkSession.createDataFrame([], "replicate int, chain_id int, src int, dst int")
    else:
        names = voxels.select("replicate", "voxel_id", "position")
        ids = voxels.agg(F.collect_set("replicate"))
        links = edges if "replicate" in edges.columns else edges.withColumn("replicate", F.explode(ids.scalar()))
        for side in ("src", "dst"):
            links = links.join(names.select("replicate", F.col("voxel_id").alias(side), F.col("position").alias(f"{side}_at")), ["replicate", side])
        links = links.select("replicate", F.col("src_at").alias("src"), F.col("dst_at").alias("dst"), chains)

    def pack(key: tuple, table: pa.Table, near: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        column = lambda c, t: np.asarray(table.column(c).to_pylist(), dtype=t)
        if None in table.column("delta").to_pylist() or None in table.column("theta").to_pylist():
            raise ValueError("initial lacks voxels of the lattice")
        if None in table.column("voxel_id").to_pylist():
            raise ValueError("a voxel without voxel_id")
        parts = table.column("partition_id").to_pylist()  # voxels without a partition form one
        names = sorted(set(parts), key=lambda n: (n is None, n or 0))
        excluded = column("excluded", bool)
        state = {
            "voxel_id": column("voxel_id", np.int32), "open": ~excluded, "part": np.array([names.index(n) for n in parts], np.int32),
            "place": np.stack([column("row", np.int32), column("col", np.int32)], axis=1) if on_lattice else np.zeros(0, np.int32),
            "edges": np.stack([np.asarray(near.column("src")), np.asarray(near.column("dst"))], axis=1).astype(np.int32),
            "delta": np.where(excluded, 0, column("delta", np.int8)).astype(np.int8),
            "theta": column("theta", np.float64).reshape(table.num_rows, config.n_basis),
            "radius": np.full(len(names) if on_lattice else 0, config.radii[0], np.int32), "candidates": np.zeros(0),
            "known": np.zeros(table.num_rows, bool), "learned": np.zeros(0, np.int32), "cuts": np.array([0, table.num_rows], np.int32),
            "trace": np.zeros((0, len(TRACE))), "alpha": max(a for a in table.column("alpha").to_pylist() if a is not None),
            "inv_sigma_sq": 1.0 / config.initial_sigma_sq, "inv_a": table.column("inv_a")[0].as_py(), "loglik": math.nan,
        }
        _map(state, config)
        state["p"] = np.where(state["p"] == 1, 0.95, np.where(state["p"] == 0, 0.05, state["p"]))
        wanted = np.array([math.nan if p is None else p for p in table.column("p").to_pylist()], dtype=float)
        state["p"] = np.where(np.isnan(wanted), state["p"], wanted)
        # The first pass builds the predictors from nothing.
        state["moved"] = np.flatnonzero((state["delta"] == 1) & state["open"])
        state["moved_by"] = state["theta"][state["moved"]]
        return _state_row(key[0].as_py(), key[1].as_py(), state)

    return rows.groupBy(*FIT).cogroup(links.groupBy(*FIT)).applyInArrow(pack, STATE)


# Draws


def _voxel_draws(states: DataFrame, config: FitConfig) -> DataFrame:
    """(replicate, chain_id, voxel_id, delta, theta, p, radius) of packed states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = _state(row, config.n_basis)
                n = len(state["voxel_id"])
                radius = state["radius"][state["part"]] if len(state["radius"]) else [None] * n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["replicate"], np.int32)), pa.array(np.full(n, row["chain_id"], np.int32)),
                        pa.array(state["voxel_id"]), pa.array(state["delta"].astype(np.int32)),
                        pa.array(list(state["theta"]), pa.list_(pa.float64())),
                        pa.array(state["p"], pa.float64(), from_pandas=True), pa.array(radius, pa.int32()),
                    ],
                    names=[*FIT, "voxel_id", "delta", "theta", "p", "radius"],
                )

    return states.mapInArrow(run, VOXEL)


VOXEL = "replicate int, chain_id int, voxel_id int, delta int, theta array<double>, p double, radius int"
SUBJECT = "replicate int, chain_id int, subject_id long, z double"


def _latent_draws(layout: DataFrame, residual: DataFrame, config: FitConfig) -> DataFrame:
    """(replicate, chain_id, subject_id, z): the latent values that a pass kept."""
    rows = layout.select("replicate", "chunk_id", "subject_id").join(residual, ["replicate", "chunk_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["subject_id"])
                z = np.frombuffer(row["z"], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(z.size, row["replicate"], np.int32)), pa.array(np.tile(np.arange(config.chains, dtype=np.int32), n)),
                        pa.array(np.repeat([int(s) for s in row["subject_id"]], config.chains), pa.int64()), pa.array(z),
                    ],
                    names=[*FIT, "subject_id", "z"],
                )

    return rows.mapInArrow(run, SUBJECT)


TRACED = "replicate int, chain_id int, draw int, " + ", ".join(f"{c} double" for c in TRACE[1:]) + ", voxels long"


def _trace_rows(states: DataFrame, config: FitConfig, last: bool) -> DataFrame:
    """The scalars that states carry; the last row only if its likelihood is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = _state(row, config.n_basis)
                trace = state["trace"] if last else state["trace"][:-1]
                n = len(trace)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["replicate"], np.int32)), pa.array(np.full(n, row["chain_id"], np.int32)),
                        pa.array(trace[:, 0].astype(np.int32)), *(pa.array(trace[:, i]) for i in range(1, len(TRACE))),
                        pa.array(np.full(n, len(state["voxel_id"])), pa.int64()),
                    ],
                    names=[*FIT, "draw", *TRACE[1:], "voxels"],
                )

    return states.mapInArrow(run, TRACED)


def _scalars(traced: DataFrame, config: FitConfig) -> DataFrame:
    """Scalar draws with the log-likelihood and log posterior of each state."""
    return traced.select(*FIT, F.col("draw").alias("iter"), *SCALARS, "loglik", log_posterior_column(config.n_basis, "voxels").alias("logpost"))


def _columns(config: FitConfig) -> int:
    """Columns of a Gram matrix such that those of all chains fit ``GRAM_BYTES``."""
    return max(1, min(MOST_COLUMNS, math.isqrt(2 * GRAM_BYTES // (8 * config.chains))))


def fit_selection_model(
    images: DataFrame,
    labels: DataFrame,
    lattice: DataFrame,
    config: FitConfig,
    edges: DataFrame | None = None,
    initial: DataFrame | None = None,
    path: str | None = None,
) -> Fit:
    """Run the sampler and return its draws.

    images  (subject_id, voxel_id, value), labels (subject_id, y), lattice
    (voxel_id, excluded, and row, col, partition_id unless ``edges`` is given);
    all may carry ``replicate``. Voxel ids may have gaps. With ``edges`` (src,
    dst) a voxel's prior is the mean over its neighbours instead of a window.
    ``initial`` holds (voxel_id, delta, theta, alpha) and maybe p, optionally
    per replicate and chain. ``labels.z``, where given, is the latent value of
    iteration 0, and of all when ``update_z`` is off.

    Iterations count from 0; the ``mcmc_sample`` draws kept are those at
    burnin + thinning, burnin + 2 thinning, ... Subjects without a kept cell
    stay, with alpha as their predictor; voxels without a partition form one.

    ``path`` names an empty folder for the fit's tables; a fit that was stopped
    goes on with ``resume_fit(spark, path)``.
    """
    spark = images.sparkSession
    images, labels = _keyed(images), _keyed(labels)
    if edges is not None and "partition_id" not in lattice.columns:
        lattice = lattice.withColumn("partition_id", F.lit(1))
    if "replicate" not in lattice.columns:
        # One row per replicate, attached to every voxel: fits are few.
        ids = labels.agg(F.collect_set("replicate"))
        lattice = lattice.withColumn("replicate", F.explode(ids.scalar()))
    lattice = lattice.withColumns({"replicate": F.col("replicate").cast("int"), "voxel_id": F.col("voxel_id").cast("int")})
    store = _Store(spark, path or os.path.join(shared_dir(spark), f"fit-{uuid.uuid4().hex}"))
    lattice = store.save(lattice, "lattice")
    voxels = store.save(lattice.join(_positions(lattice), ["replicate", "voxel_id"]), "positions")

    sizes = voxels.groupBy("replicate").agg(F.count("*").cast("int").alias("voxels"))
    top = sizes.agg(F.max("voxels")).head()[0]
    people = labels.groupBy("replicate").count().agg(F.max("count")).head()[0]
    chunks = _chunk_count(people, top, config, spark.sparkContext.defaultParallelism)
    store.save(_chunks(images, labels, voxels, sizes, chunks), "layout")
    store.save(_start(voxels, edges, initial, config), "state", -1)
    plan = {"config": asdict(config), "top": top, "chunks": chunks, "lattice": edges is None, "given_z": "z" in labels.columns}
    store.save(spark.createDataFrame([(json.dumps(plan),)], "plan string"), "plan")
    mark = (-1, -1, -1, 0, 0)
    store.mark(*mark)
    return _run(store, config, plan, mark)


def resume_fit(spark: SparkSession, path: str) -> Fit:
    """Go on with a fit that was stopped, behind the last iteration it committed.

    Draws written after the last mark are written anew. The result is that of
    an unbroken run; a finished fit repeats its last pass only.
    """
    store = _Store(spark, path)
    mark = store.last_mark()
    if mark is None:
        raise ValueError(f"no fit has begun in {path}")
    plan = json.loads(store.load("plan", schema="plan string").head()[0])
    config = FitConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in plan["config"].items()})
    return _finished(store, config) if "done" in file_names(spark, path) else _run(store, config, plan, mark)


class _Runner:
    """The jobs of a fit: which tables of states, residuals and tiles are current, and which may go.

    A mark holds the iteration, the numbers of the state and of the pass with
    the residuals, and the range of tables of tiles.
    """

    def __init__(self, store: _Store, config: FitConfig, plan: dict, mark: tuple[int, ...]):
        self.store, self.config = store, config
        self.iteration, self.number, passed, self.fills, self.first_fill = mark
        spark = store.spark
        parts = max(
            spark.sparkContext.defaultParallelism, math.ceil(plan["chunks"] / CHUNKS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))
        )
        layout = store.load("layout", schema=LAYOUT)
        self.layout = layout.repartition(parts, "replicate", "chunk_id").persist(StorageLevel.MEMORY_AND_DISK)
        self.states = store.load("state", self.number, STATE)
        self.state_bytes = plan["top"] * (16 * config.n_basis + 64) + 8 * len(TRACE) * TRACE_ROWS
        self.most = config.block_voxels or max(1, GROUP_COLUMNS // config.n_basis)
        self.passed = passed
        self.committed, self.written = [("state", self.number), ("pass", passed)], []
        self.residual = self._residual() if passed >= 0 else spark.createDataFrame([], "replicate int, chunk_id int, z binary, eta binary")
        self.tiles, self.cuts = None, []
        self._open_tiles()

    def _residual(self) -> DataFrame:
        rows = self.store.load("pass", self.passed, PASS).where("kind = 1")
        return rows.select("replicate", "chunk_id", "z", "eta")

    def _save_states(self, states: DataFrame) -> None:
        self.number += 1
        self.states = self.store.save(states, "state", self.number)
        self.written.append(("state", self.number))

    def _open_tiles(self) -> None:
        numbers = list(range(self.first_fill, self.fills))
        if numbers:
            self.tiles = self.store.all_iterations("tiles", TILES, numbers)
        self.cuts = [np.frombuffer(r.cuts, np.int32) for r in self.states.select("replicate", "cuts").distinct().collect()]

    def groups(self) -> int:
        """Groups of voxels with tiles, after tiles were made for voxels selected for the first time."""
        if self.config.update_theta and self.states.agg(F.max("fresh")).head()[0]:
            self._save_states(_learned(self.states, self.config, self.most))
            at_once = max(1, GRAM_BYTES // (8 * self.most * self.config.n_basis**2))
            count = self.states.agg(F.max(F.octet_length("learned"))).head()[0] // 4
            for start in range(0, count, at_once):
                strips = _strips(self.layout, self.states, slice(start, start + at_once), self.config, self.state_bytes)
                self.store.save(strips, "tiles", self.fills, by="shelf")
                self.fills += 1
            self._open_tiles()
        return max((len(cuts) - 1 for cuts in self.cuts), default=1)

    def _tiles(self, job: _Job) -> DataFrame | None:
        bounds = [cuts[job.number : job.number + 2] for cuts in self.cuts if len(cuts) > job.number + 1]
        if job.kind != "theta" or job.still or not self.config.update_theta or self.tiles is None:
            return None
        shelves = sorted({shelf for low, high in bounds for shelf in range(int(low) // SHELF, int(high - 1) // SHELF + 1)})
        return _tiles_of(self.tiles.where(F.col("shelf").isin(shelves)), self.states, job, self.config)

    def advance(self, job: _Job) -> None:
        rows = _pass(self.layout, self.residual, self.states, job, self.config, self.state_bytes)
        self.passed = self.number + 1
        # Sums and residuals lie apart, so that a step reads no residual.
        sums = self.store.save(rows, "pass", self.passed, by="kind").where("kind = 0")
        self.written.append(("pass", self.passed))
        self.residual = self._residual()
        self._save_states(_step(self.states, sums, self._tiles(job), job, self.config))
        self._forget([("state", self.number), ("pass", self.passed)])

    def _forget(self, needed: list[tuple[str, int]]) -> None:
        """Drop superseded tables of the running iteration; those of the last mark stay until the next."""
        for name in [w for w in self.written if w not in needed]:
            self.store.drop(*name)
            self.written.remove(name)

    def commit(self, iteration: int) -> None:
        old, old_fill = self.committed, self.first_fill
        if self.fills - self.first_fill > MOST_FILLS:
            merged = self.tiles.drop("iter").repartition("shelf")
            self.store.save(merged, "tiles", self.fills, by="shelf")
            self.first_fill, self.fills = self.fills, self.fills + 1
            self._open_tiles()
        self.store.mark(iteration, self.number, self.passed, self.fills, self.first_fill)
        self.committed = [("state", self.number), ("pass", self.passed)]
        self.written = [w for w in self.written if w not in self.committed]
        for name in old:
            if name not in self.committed:
                self.store.drop(*name)
        for number in range(old_fill, self.first_fill):
            self.store.drop("tiles", number)


def _run(store: _Store, config: FitConfig, plan: dict, mark: tuple[int, ...]) -> Fit:
    """Iterations behind the mark, and the fit's tables."""
    run = _Runner(store, config, plan, mark)
    delta_block = config.block_voxels or _columns(config)
    delta_blocks = max(1, math.ceil(plan["top"] / delta_block)) if config.update_delta else 1
    trim = run.iteration >= 0 and (run.iteration + 1) % TRACE_ROWS == 0
    for iteration in range(run.iteration + 1, config.total_iter):
        given = not config.update_z or (iteration == 0 and plan["given_z"])
        for number in range(run.groups()):
            run.advance(_Job("theta", number, 0, iteration, given, trim=trim and number == 0))
            if number == 0 and config.keep_latent and config.retained(iteration):
                store.save(_latent_draws(run.layout, run.residual, config), "subject", iteration)
        due = plan["lattice"] and config.update_delta and len(config.radii) > 1 and iteration % config.radius_update_thinning == 0
        for number in range(delta_blocks):
            run.advance(_Job("delta", number, delta_block, iteration, given, due and number == 0, number == delta_blocks - 1))
        if config.retained(iteration) or config.keep_burnin:
            store.save(_voxel_draws(run.states, config), "voxel", iteration)
        trim = (iteration + 1) % TRACE_ROWS == 0
        if trim:
            store.save(_trace_rows(run.states, config, False), "trace", iteration)
        run.commit(iteration)

    # The likelihood of a state is a by-product of the next pass; nothing moves in this one.
    run.advance(_Job("theta", 0, 0, config.total_iter, True, still=True, trim=trim))
    store.save(_trace_rows(run.states, config, True), "trace", config.total_iter)
    run.layout.unpersist()
    touch(store.spark, store.where("done"))
    for name in ("layout", "state", "pass", "tiles"):
        store.drop(name)
    return _finished(store, config)


def _finished(store: _Store, config: FitConfig) -> Fit:
    draws = store.all_iterations("voxel", VOXEL)
    known = store.load("positions").select("replicate", "voxel_id", "partition_id", "excluded")
    return Fit(
        voxel=draws.join(known, ["replicate", "voxel_id"]).select(*FIT, "iter", "voxel_id", "partition_id", "excluded", "delta", "theta", "p", "radius"),
        scalar=_scalars(store.all_iterations("trace", TRACED), config),
        subject=store.all_iterations("subject", SUBJECT) if config.keep_latent else None,
        path=store.path,
    )


def summarise(fit: Fit, config: FitConfig, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Posterior means over the retained draws, per (replicate, chain).

    ``voxel`` has delta and theta, ``scalar`` alpha, sigma^2 and a, ``radius``
    the last radius per partition, ``subject`` the latent means if kept.
    """

    def kept(draws: DataFrame) -> DataFrame:
        return posterior.retain_draws(draws, config.burnin, config.thinning)

    means = {
        "voxel": posterior.posterior_mean_voxel(kept(fit.voxel), config.n_basis, threshold, FIT),
        "scalar": posterior.posterior_mean_global(kept(fit.scalar), FIT),
        "radius": posterior.last_radius(fit.voxel.where("radius is not null"), FIT),
    }
    if fit.subject is not None:
        means["subject"] = posterior.posterior_mean_subject(kept(fit.subject), FIT)
    return means

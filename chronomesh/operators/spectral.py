"""Spectral kernel: feature vectors to ground states of a Hermitian family, their metric's spectrum, and training of the family.

A point x has the operator H(x) = K - sum x_k A_k with K = 1/2 sum A_k^2. Its ground state
gives the projection y_k = <A_k>; at y the transitions to excited states, scaled by the
gaps, form a real feature matrix whose squared singular values are the spectrum and whose
squared column sums are the metric's diagonal. Operators have a fixed size (D x N x N, both
parameters) and are broadcast; points stay distributed, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_FLOOR = 1e-7
BETAS, DECAY = (0.9, 0.999), 0.01
#: Diagonal steps, relative to the largest entry, that a failed eigensolve is repeated with.
JITTERS = (0.0, 1e-12, 1e-10, 1e-8)


def initial_operators(dimension: int, states: int, seed: int) -> np.ndarray:
    """Unconstrained complex matrices, normal with deviation 1 / sqrt(states)."""
    rng = np.random.default_rng(seed)
    shape = (dimension, states, states)
    return (rng.standard_normal(shape) + 1j * rng.standard_normal(shape)) / np.sqrt(states)


def hermitian(m: np.ndarray) -> np.ndarray:
    return (m + np.conj(np.swapaxes(m, -1, -2))) / 2


def half_squares(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.einsum("dnm,dmk->nk", a, a)


def eigen(x: np.ndarray, a: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of H(x) for a batch of points.

    Matrices are centred on their mean eigenvalue. Where the solver doesn't converge, it is
    tried again with ever larger diagonal steps, which tell equal eigenvalues apart.
    """
    h = hermitian(k[None] - np.einsum("bd,dnm->bnm", x, a))
    n = h.shape[-1]
    centre = np.trace(h, axis1=1, axis2=2).real / n
    h = h - centre[:, None, None] * np.eye(n)
    size = np.maximum(np.abs(h).max(axis=(1, 2), initial=0), 1e-300)
    for jitter in JITTERS:
        try:
            energy, states = np.linalg.eigh(h + (jitter * size)[:, None, None] * np.diag(np.arange(n)))
        except np.linalg.LinAlgError:
            continue
        return energy + centre[:, None], states
    raise np.linalg.LinAlgError("the eigenvalues of a point's operator don't converge")


def expectations(psi: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.einsum("bn,dnm,bm->bd", psi.conj(), a, psi, optimize=True).real


def describe(x: np.ndarray, a: np.ndarray, gap_floor: float | None = GAP_FLOOR) -> dict[str, np.ndarray]:
    """All that the kernel returns for a batch x of points."""
    k = half_squares(a)
    energy, states = eigen(x, a, k)
    psi = states[:, :, 0]
    y = expectations(psi, a)
    variance = np.maximum(2 * np.einsum("bn,nm,bm->b", psi.conj(), k, psi).real - (y**2).sum(1), 0)
    at_y, states_y = eigen(y, a, k)
    gaps = at_y[:, 1:] - at_y[:, :1]
    gaps = np.maximum(gaps, gap_floor) if gap_floor else gaps
    moved = np.einsum("bn,dnm,bmk->bkd", states_y[:, :, 0].conj(), a, states_y[:, :, 1:], optimize=True) * np.sqrt(2 / gaps)[:, :, None]
    features = np.concatenate([moved.real, moved.imag], axis=1)
    diagonal = (features**2).sum(1)
    singular = np.linalg.svd(features, compute_uv=False) ** 2
    spectrum = np.zeros((len(x), features.shape[1]))
    spectrum[:, : singular.shape[1]] = singular
    return {
        "projected": y,
        "eigenvalues": spectrum,
        "metric_diagonal": diagonal,
        "metric_trace": diagonal.sum(1),
        "residual": np.linalg.norm(y - x, axis=1),
        "local_variance": variance,
        "ground_eigenvalue": energy[:, 0] + 0.5 * (x**2).sum(1),
        "first_gap": energy[:, 1] - energy[:, 0],
    }


SPECTRUM = (
    "id long, projected array<double>, eigenvalues array<double>, metric_diagonal array<double>, metric_trace double, residual double, "
    "local_variance double, ground_eigenvalue double, first_gap double"
)


def spectra(points: DataFrame, operators: np.ndarray, batch: int = 256) -> DataFrame:
    """(SPECTRUM) for points (id, features); points whose features are null or not finite are left out."""
    shared = points.sparkSession.sparkContext.broadcast(hermitian(operators))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        names = [c.split()[0] for c in SPECTRUM.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                x = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                found = describe(x, a)
                columns = [pa.array(list(v)) if v.ndim == 2 else pa.array(v) for v in (found[n] for n in names[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    finite = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ready = points.where(F.col("features").isNotNull() & (F.size("features") == operators.shape[0])).where(finite)
    return ready.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(run, SPECTRUM)


def loss_and_gradient(x: np.ndarray, raw: np.ndarray, variance_weight: float, soften: float = 1.0) -> tuple[float, np.ndarray]:
    """Sums over the batch of the loss and its gradient in the real and imaginary parts of raw.

    First-order perturbation: a change dH moves the ground state by
    -sum_n |n><n|dH|0> / gap_n, so with g the gradient in the state, the gradient in H is
    the Hermitian part of -(sum_n |n><n|g> / gap_n) <0|. Small gaps are softened: 1 / gap
    becomes gap / (gap^2 + width^2), with width the range of energies over states^2.
    """
    d, n, _ = raw.shape
    a = hermitian(raw)
    k = half_squares(a)
    energy, states = eigen(x, a, k)
    psi, excited = states[:, :, 0], states[:, :, 1:]
    y = expectations(psi, a)
    gaps = energy[:, 1:] - energy[:, :1]
    width = soften * (energy[:, -1:] - energy[:, :1]) / n**2
    resolvent = gaps / (gaps**2 + width**2)
    variance = 2 * np.einsum("bn,nm,bm->b", psi.conj(), k, psi).real - (y**2).sum(1)
    on = (variance > 0).astype(float) * variance_weight
    loss = float((((y - x) ** 2).sum(1) + np.where(variance > 0, variance, 0) * variance_weight).sum() / d)
    # how the loss changes with y and, at fixed y, with <K>
    dy = (2 * (y - x) - 2 * on[:, None] * y) / d
    dk = 2 * on / d
    force = np.einsum("bd,dnm->bnm", dy, a) + dk[:, None, None] * k[None]
    g = np.einsum("bnm,bm->bn", force, psi)
    lift = np.einsum("bnk,bk->bn", excited, np.einsum("bnk,bn->bk", excited.conj(), g) * resolvent)
    dh = -2 * hermitian(lift[:, :, None] * psi.conj()[:, None, :])
    outer = psi[:, :, None] * psi.conj()[:, None, :]
    # A_k enters through y directly, through H linearly and through K quadratically
    in_a = np.einsum("bd,bnm->dnm", dy, outer) - np.einsum("bd,bnm->dnm", x, dh)
    in_k = (dh + dk[:, None, None] * outer).sum(0)
    in_a = in_a + 0.5 * (np.einsum("nm,dmk->dnk", in_k, a) + np.einsum("dnm,mk->dnk", a, in_k))
    return loss, hermitian(in_a)


def distributed_gradient(points: DataFrame, raw: np.ndarray, variance_weight: float) -> tuple[float, np.ndarray, int]:
    """Mean loss and gradient over points (id, features): each task returns one fixed-size sum, those are added up in Spark."""
    shared = points.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gradient, n = 0.0, np.zeros_like(shared.value), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                x = np.array(whole.column(0).slice(at, 256).to_pylist(), float)
                loss, g = loss_and_gradient(x, shared.value, variance_weight)
                total, gradient, n = total + loss, gradient + g, n + len(x)
        flat = np.concatenate([gradient.real.ravel(), gradient.imag.ravel(), [total, n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    sums = points.select("features").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    flat = np.array([r["x"] for r in sums])
    n = max(1, int(flat[-1]))
    size = raw.size
    gradient = (flat[:size] + 1j * flat[size : 2 * size]).reshape(raw.shape)
    return flat[-2] / n, gradient / n, n


def commutator_penalty(a: np.ndarray, pairs: int, seed: int) -> float:
    """Minus the mean squared norm of the commutators of random pairs of operators."""
    return commutator_gradient(a, pairs, seed)[0]


def commutator_gradient(a: np.ndarray, pairs: int, seed: int) -> tuple[float, np.ndarray]:
    """The penalty and its gradient in Hermitian operators a."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(a), (2, pairs))
    c = a[i] @ a[j] - a[j] @ a[i]
    gradient = np.zeros_like(a)
    dagger = np.conj(np.swapaxes(c, -1, -2))
    # d|C|^2 = 2 Re tr(C^+ (dA_i A_j - A_j dA_i + A_i dA_j - dA_j A_i))
    np.add.at(gradient, i, 2 * np.conj(np.swapaxes(a[j] @ dagger - dagger @ a[j], -1, -2)))
    np.add.at(gradient, j, 2 * np.conj(np.swapaxes(dagger @ a[i] - a[i] @ dagger, -1, -2)))
    return float(-(np.abs(c) ** 2).sum((1, 2)).mean()), hermitian(-gradient / pairs)


class Adam:
    """AdamW steps for operators, with the gradient clipped by its norm."""

    def __init__(self, raw: np.ndarray, rate: float, clip: float):
        self.raw, self.rate, self.clip, self.t = raw, rate, clip, 0
        self.m, self.v = np.zeros_like(raw), np.zeros((2, *raw.shape))

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        g = g * min(1.0, self.clip / (np.sqrt((np.abs(g) ** 2).sum()) + 1e-6))
        self.m = BETAS[0] * self.m + (1 - BETAS[0]) * g
        self.v = BETAS[1] * self.v + (1 - BETAS[1]) * np.stack([g.real**2, g.imag**2])
        scale = np.sqrt(self.v / (1 - BETAS[1] ** self.t)) + 1e-8
        step = self.m / (1 - BETAS[0] ** self.t)
        self.raw = self.raw * (1 - self.rate * DECAY) - self.rate * (step.real / scale[0] + 1j * step.imag / scale[1])


def train(
    points: DataFrame,
    held: DataFrame | None,
    states: int,
    steps: int,
    rate: float = 1e-2,
    variance_weight: float = 0.0,
    commutator_weight: float = 0.0,
    pairs: int = 8,
    clip: float = 1.0,
    seed: int = 0,
) -> tuple[np.ndarray, list[dict]]:
    """Operators trained on full-batch gradients, and a history: the loss before each step, and that of the held-out points before every twentieth part of the steps and after the last one."""
    dimension = len(points.select("features").first()[0])
    adam, history = Adam(initial_operators(dimension, states, seed), rate, clip), []
    for t in range(steps + 1):
        loss, g, _ = distributed_gradient(points, adam.raw, variance_weight)
        if commutator_weight:
            penalty, own = commutator_gradient(hermitian(adam.raw), pairs, seed + t)
            loss, g = loss + commutator_weight * penalty, g + commutator_weight * own
        row = {"step": t, "loss": float(loss), "held_loss": None, "held_residual": None}
        if held is not None and (t % max(1, steps // 20) == 0 or t == steps):
            row |= validation(held, adam.raw, variance_weight)
        history.append(row)
        if t < steps:
            adam.step(g)
    return adam.raw, history


def validation(held: DataFrame, raw: np.ndarray, variance_weight: float) -> dict[str, float]:
    """Mean loss and residual of points that took no part in the training."""
    found = spectra(held, raw)
    square = F.col("residual") ** 2 + variance_weight * F.col("local_variance")
    row = found.agg(F.avg(square / len(raw)).alias("held_loss"), F.avg("residual").alias("held_residual")).first()
    return row.asDict()


def fit(points: DataFrame, states: int, steps: int, rate: float = 1e-2, variance_weight: float = 0.0, clip: float = 1.0, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """Operators trained by AdamW on full-batch gradients, and the loss before each step."""
    raw, history = train(points, None, states, steps, rate, variance_weight, 0.0, 0, clip, seed)
    return raw, [r["loss"] for r in history[:-1]]


def epochs_for(target_steps: int, samples: int, batch: int) -> int:
    """Epochs that make up a budget of steps."""
    return -(-target_steps // max(1, -(-samples // batch)))

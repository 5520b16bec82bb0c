"""State lattice, scores and verdicts as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States from strongest to weakest claim; the worse one wins.
LATTICE = ("STABLE", "SLEEPING", "WEAK", "SATURATED", "NEG_ZERO", "UNSTABLE", "DEGENERATE")
#: Base matrix of the field score, and its weights.
FIELD = ((1.00, 0.00, 0.00), (0.75, 0.15, 0.10), (0.70, 0.10, 0.20))
FIELD_ROUNDS = 5
FIELD_WEIGHTS = (0.6, 0.2, 0.2)
#: Impact of kinds of change.
IMPACT = {"Refactor": 0.25, "Patch": 0.08, "Feature": 0.15}


def rank(state: Column) -> Column:
    """Position of a state in the lattice (0 best); unknown states are null."""
    table = F.create_map(*[F.lit(x) for k, s in enumerate(LATTICE) for x in (s, k)])
    return table[state]


def state_at(position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LATTICE)), position.cast("int") + 1)


def combine(*states: Column) -> Column:
    """The worst of several states."""
    return state_at(F.greatest(*map(rank, states)))


def field_score(s: Column, c: Column, p: Column, adjustment: Column | None = None) -> Column:
    """Score to which (s, c, p) is drawn by the base matrix in five normalised rounds."""
    v = F.array(s.cast("double"), c.cast("double"), p.cast("double"))
    product = lambda a: F.array(*[sum((F.lit(w) * a.getItem(j) for j, w in enumerate(row)), F.lit(0.0)) for row in FIELD])

    def step(acc: Column, _: Column) -> Column:
        made = product(acc)
        return F.transform(made, lambda x: x / F.when(F.array_max(product(acc)) > 0, F.array_max(product(acc))).otherwise(1.0))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(FIELD_ROUNDS)), v, step)
    score = sum((F.lit(w) * last.getItem(j) for j, w in enumerate(FIELD_WEIGHTS)), F.lit(0.0))
    if adjustment is None:
        return score
    return F.when(adjustment != 0, F.greatest(score + adjustment, F.lit(0.0))).otherwise(score)


def secret_adjustment(risk: Column, most: float = 0.10) -> Column:
    """Deduction for a secret risk, at most ``most``."""
    return F.when(risk <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-most), -risk * most))


def condition_number(matrix: tuple[tuple[float, ...], ...] = FIELD) -> float:
    """Infinity-norm condition number of a 3x3 matrix by cofactors; infinite where it is singular."""
    (a, b, c), (d, e, f), (g, h, i) = matrix
    cofactors = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    det = a * cofactors[0][0] + b * cofactors[1][0] + c * cofactors[2][0]
    if abs(det) < 1e-9:
        return float("inf")
    norm = lambda m: max(sum(map(abs, row)) for row in m)
    return norm(matrix) * norm(tuple(tuple(x / det for x in row) for row in cofactors))


def inverse(m: list[list[Column]], tiny: float = 1e-9) -> list[list[Column]]:
    """Inverse of a 3x3 matrix of Columns by cofactors; null where its determinant is below ``tiny``."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    return [[F.when(F.abs(det) >= tiny, minor(j, i) / det) for j in range(3)] for i in range(3)]


def row_norm(m: list[list[Column]]) -> Column:
    """Largest sum of absolute values of a row."""
    return F.greatest(*[F.abs(r[0]) + F.abs(r[1]) + F.abs(r[2]) for r in m])


def matmul(a: DataFrame, b: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Product of matrices in rows (within..., i, j, v): one equi-join and a sum, missing elements are 0."""
    keys = list(within or [])
    right = b.select(*keys, F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(right, [*keys, "j"]).groupBy(*keys, "i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("v"))


def pseudo_inverse(a: np.ndarray, tiny: float = 1e-9) -> np.ndarray:
    """Of a matrix of few rows: the inverse, or where it is singular the Moore-Penrose inverse."""
    return np.linalg.inv(a) if a.shape[0] == a.shape[1] and abs(np.linalg.det(a)) >= tiny else np.linalg.pinv(a, rcond=tiny)


def confidence(stability: Column) -> Column:
    """1 / (1 + log10 of the stability), within 0 and 1, to three places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.log10(stability)))), 3)


def pulse(aura: Column, magnitude: Column, kind: Column) -> Column:
    """Predicted score after a change of a kind and magnitude."""
    table = F.create_map(*[F.lit(x) for pair in IMPACT.items() for x in pair])
    return aura * (1 - F.coalesce(table[kind], F.lit(0.1)) * magnitude)


def drift_gate(drift: Column) -> Column:
    return F.when(drift > 0.20, "fail").when(drift > 0.05, "warn").otherwise("ok")


def band(value: Column, stable: float, weak: float, unstable: float, rising: bool = True) -> Column:
    """State of a value by three bounds, from above (rising) or below."""
    at = (lambda x: value >= x) if rising else (lambda x: value <= x)
    return F.when(at(stable), "STABLE").when(at(weak), "WEAK").when(at(unstable), "UNSTABLE").otherwise("DEGENERATE")


def heal(state: Column, value: Column, count: Column) -> Column:
    """Healing of NEG_ZERO and UNSTABLE: struct(value, state, heal_count); others stay as they are."""
    sick = state.isin("NEG_ZERO", "UNSTABLE")
    return F.struct(
        F.when(sick, 1e-6 * (1 + count)).otherwise(value).alias("value"), F.when(sick, "WEAK").otherwise(state).alias("state"), F.when(sick, count + 1).otherwise(count).alias("heal_count")
    )


def divide(a: Column, b: Column, a_state: Column, b_state: Column) -> Column:
    """Division of states: by zero it is 0 and UNSTABLE, whatever the operands' states."""
    zero = b == 0
    return F.struct(F.when(zero, 0.0).otherwise(F.try_divide(a, b)).alias("value"), F.when(zero, "UNSTABLE").otherwise(combine(a_state, b_state)).alias("state"))


def guard_verdict(match_ratio: Column, chaos: Column, violations: Column) -> Column:
    """Verdict on generated code; its raw state is healed before it is judged."""
    c = F.least(F.lit(1.0), chaos / 8)
    raw = combine(band(match_ratio, 0.9, 0.7, 0.4), band(c, 0.1, 0.3, 0.6, rising=False))
    healed = F.when(raw == "UNSTABLE", "WEAK").otherwise(raw)
    return F.when((healed == "STABLE") & ~violations, "SAFE").when(healed == "WEAK", "WARNING").otherwise("HALLUCINATION_DETECTED")


def answer_mode(match_ratio: Column) -> Column:
    """Mode of answers by the share of symbols that are known."""
    return F.when(match_ratio >= 0.90, "strict").otherwise("relaxed")


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS; null and negative values count as 0."""
    s = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def verify_verdict(s: Column, c: Column, p: Column, clean: Column) -> Column:
    """Verdict of a verification from its structure, chaos and freshness; the raw state is healed first."""
    raw = combine(band(s, 0.8, 0.5, 0.2), band(c, 0.1, 0.3, 0.6, rising=False), band(p, 0.9, 0.7, 0.4))
    healed = F.when(raw == "UNSTABLE", "WEAK").otherwise(raw)
    return F.when((healed == "STABLE") & clean, "SEALED_STABLE").when(healed == "WEAK", "WEAK").otherwise("DEGENERATE")

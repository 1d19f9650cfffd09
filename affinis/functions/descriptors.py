"""The 18-number shape descriptor of a conformer, and checks of geometry, as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Factors of the fourth and fifth coordinate.
CHARGE_SCALE, LOGP_SCALE = 25.0, 5.0


def _centroids(points: np.ndarray) -> np.ndarray:
    """Six reference points of a set of atoms in five dimensions (x, y, z, scaled charge, scaled logP).

    The centre; the atom farthest from it; the atom farthest from that one; the centre moved half the way to the farthest
    atom, in space, at right angles to both directions, once at the highest and once at the lowest charge; and the
    centre moved along logP by the distance of the farthest atom.
    """

    def farthest(origin: np.ndarray) -> np.ndarray:
        return points[((points - origin) ** 2).sum(axis=1).argmax()]

    centre = points.mean(axis=0)
    far = farthest(centre)
    arm, other = far - centre, farthest(far) - centre
    normal = np.cross(arm[:3], other[:3])
    size = np.sqrt(normal @ normal)
    six = np.tile(centre, (6, 1))
    six[1], six[2] = far, other + centre
    if size > 1e-6:
        six[3:5, :3] += normal * (np.sqrt(arm[:3] @ arm[:3]) / (2 * size))
    six[3, 3], six[4, 3] = points[:, 3].max(), points[:, 3].min()
    six[5, 4] += np.sqrt(arm @ arm)
    return six


def shape_moments(points: np.ndarray) -> np.ndarray:
    """Mean, deviation and signed cube root of the third moment of the distances to six centroids; needs 4 atoms."""
    gaps = np.sqrt(((points[None] - _centroids(points)[:, None]) ** 2).sum(axis=2))
    around = gaps - gaps.mean(axis=1, keepdims=True)
    return np.stack([gaps.mean(axis=1), np.sqrt((around**2).mean(axis=1)), np.cbrt((around**3).mean(axis=1))], axis=1).ravel()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def shape_descriptor(points: pd.Series) -> pd.Series:
    """shape_moments of a list of atoms; NULL for fewer than four."""
    return pd.Series([None if p is None or len(p) < 4 else shape_moments(np.array([list(x) for x in p], float)).astype(np.float32) for p in points])


def conformer_rows(df: DataFrame, key: str, energy: Column, atoms: Column, most: int = 20) -> DataFrame:
    """(key, conformers): descriptors of the lowest-energy conformers of each molecule, at most ``most``."""
    d = df.select(F.col(key), F.struct(energy.alias("e"), shape_descriptor(atoms).alias("d")).alias("c")).filter("c.d IS NOT NULL")
    return d.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("c")), 1, most).alias("c")).select(key, F.col("c.d").alias("conformers"))  # conformers of one molecule


@F.pandas_udf(T.StructType([T.StructField("least_distance", T.DoubleType()), T.StructField("invariance", T.DoubleType())]))
def geometry_check(points: pd.Series) -> pd.DataFrame:
    """The least distance of two atoms, and the change of the descriptor under a rotation and a shift."""
    least, change = [], []
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    for p in points:
        if p is None or len(p) < 4:
            least.append(None)
            change.append(None)
            continue
        x = np.array([list(a) for a in p], float)
        gap = np.linalg.norm(x[:, None, :3] - x[None, :, :3], axis=2) + np.eye(len(x)) * 1e9
        moved = x.copy()
        moved[:, :3] = x[:, :3] @ turn.T + np.array([1.0, -2.0, 3.0])
        least.append(gap.min())
        change.append(np.abs(shape_moments(x) - shape_moments(moved)).max())
    return pd.DataFrame({"least_distance": least, "invariance": change})

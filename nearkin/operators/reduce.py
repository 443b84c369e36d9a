"""Two-dimensional maps of a corpus: PCA coordinates and point roles."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import vectors as V
from nearkin.sources.storage import settled

MAX_BROADCAST_ROLES = 10_000

QUERY, NEIGHBOUR, BACKGROUND = "query", "neighbour", "background"


def pca_2d(documents: DataFrame, vector_col: str = "v") -> DataFrame:
    """Add ``pc1, pc2``: coordinates on the first two principal components.

    Spark's model projects without centring, so the projected mean is taken off.
    Each component's sign is fixed: its largest absolute loading is positive.
    """
    vec = array_to_vector(V.as_double(F.col(vector_col)))
    points = documents.withColumn("_vec", vec)
    model = PCA(k=2, inputCol="_vec", outputCol="_pc").fit(points)
    mean = points.agg(Summarizer.mean(F.col("_vec")).alias("m")).first()["m"].toArray()
    axes = model.pc.toArray()
    largest = np.abs(axes).argmax(axis=0)
    signs = np.where(axes[largest, [0, 1]] < 0, -1.0, 1.0)
    centre = mean @ axes
    projected = model.transform(points).withColumn("_p", vector_to_array("_pc"))
    coordinates = {
        f"pc{i + 1}": (F.col("_p")[i] - float(centre[i])) * float(signs[i])
        for i in range(2)
    }
    return projected.withColumns(coordinates).drop("_vec", "_pc", "_p")


def role_table(spark, query: str | None, neighbours: Sequence[str]) -> DataFrame:
    """``filename, role`` rows for one query file and its neighbours."""
    rows = [(name, NEIGHBOUR) for name in neighbours]
    if query is not None:
        rows.append((query, QUERY))
    return spark.createDataFrame(rows, "filename string, role string")


def label_roles(points: DataFrame, roles: DataFrame) -> DataFrame:
    """Add ``role``; everything unnamed is background.

    A file that is both query and neighbour is the query. All rows of a
    filename get its role.
    """
    return _with_roles(points, settled(roles, MAX_BROADCAST_ROLES)[0])


def _with_roles(points: DataFrame, roles: DataFrame) -> DataFrame:
    # 'query' is the larger of the two words, so max() is the precedence rule
    one = roles.groupBy("filename").agg(F.max("role").alias("role"))
    role = F.coalesce("role", F.lit(BACKGROUND))
    return points.join(one, "filename", "left").withColumn("role", role)


def missing_roles(points: DataFrame, roles: DataFrame) -> DataFrame:
    """Named files that no point has."""
    return roles.join(points.select("filename"), "filename", "left_anti").distinct()


def similarity_map(
    documents: DataFrame,
    roles: DataFrame,
    *,
    vector_col: str = "v",
    require_query: bool = False,
    warn_missing: bool = False,
) -> DataFrame:
    """PCA coordinates with roles.

    ``require_query`` makes an absent query file an error; ``warn_missing``
    warns about absent neighbours, which are otherwise passed over.
    """
    roles, _ = settled(roles, MAX_BROADCAST_ROLES)
    if require_query or warn_missing:
        # at most one small row per requested name
        absent = missing_roles(documents, roles).toLocalIterator()
        for row in absent:
            if row.role == QUERY and require_query:
                raise ValueError(f"query file {row.filename!r} not found")
            if row.role == NEIGHBOUR and warn_missing:
                warnings.warn(f"neighbour {row.filename!r} not found", stacklevel=2)
    return _with_roles(pca_2d(documents, vector_col), roles)

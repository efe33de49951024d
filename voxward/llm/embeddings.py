"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.llm.components import connected_components
from voxward.llm.tables import stored


@dataclass(frozen=True)
class CellParams:
    """``cosine`` links two vectors; each looks for partners in its ``probes`` nearest cells.

    Cells are fitted on the ``sample`` vectors of smallest hash, the square root of a
    label's number of vectors, at most a quarter of its sample. Every vector is
    assigned; cells with more than ``block`` members are compared block by block.
    """

    cosine: float = 0.93
    probes: int = 8
    sample: int = 20_000
    rounds: int = 8
    block: int = 1024

    def __post_init__(self) -> None:
        if min(self.probes, self.sample, self.rounds, self.block) < 1 or not 0 < self.cosine <= 1:
            raise ValueError("probes, sample, rounds and block must be positive, cosine between 0 and 1")


def _unit(vectors: pd.Series | list) -> np.ndarray:
    rows = np.asarray([np.asarray(v, np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _fit(vectors: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of spherical k-means; starts from evenly spaced vectors, empty cells keep their centre."""
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _centres(reps: DataFrame, params: CellParams) -> dict[tuple[int, int], np.ndarray]:
    """Centres by label and dimension; no more rows than a quarter of the sample reach the driver."""
    sizes = reps.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("members"))
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(params.sample)
    sample = sample.withColumn("dim", F.size("vector")).join(sizes, ["label", "dim"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        members = int(group["members"].iloc[0])
        cells = max(1, min(int(np.ceil(members**0.5)), len(group) // 4))
        centres = _fit(_unit(group["vector"]), cells, params.rounds)
        return pd.DataFrame({"label": group["label"].iloc[0], "dim": group["dim"].iloc[0], "centre": list(centres)})

    found: dict[tuple[int, int], list] = {}
    for row in sample.groupBy("label", "dim").applyInPandas(fit, "label int, dim int, centre array<double>").toLocalIterator():
        found.setdefault((row["label"], row["dim"]), []).append(row["centre"])
    return {key: np.array(rows) for key, rows in found.items()}


def _assigned(reps: DataFrame, centres: dict[tuple[int, int], np.ndarray], params: CellParams) -> DataFrame:
    """Each vector with its nearest cells, ascending; labels without a sample have one cell."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["dim"] = batch["vector"].map(len)
            for key, part in batch.groupby(["label", "dim"]):
                own = shared.value.get((int(key[0]), int(key[1])))
                cells = np.zeros((len(part), 1), int)
                if own is not None:
                    likeness = _unit(part["vector"]) @ own.T
                    cells = np.sort(np.argsort(-likeness, axis=1, kind="stable")[:, : params.probes], axis=1)
                yield part.assign(cells=list(cells))[["rep", "label", "dim", "weight", "vector", "cells"]]

    return reps.select("rep", "label", "weight", "vector").mapInPandas(
        run, "rep bigint, label int, dim int, weight bigint, vector array<float>, cells array<int>"
    )


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row it is connected to."""
    label = np.arange(len(linked))
    some = np.flatnonzero(linked.any(axis=1))
    near = linked[np.ix_(some, some)]
    while len(some):
        low = np.minimum(label[some], np.where(near, label[some], len(linked)).min(axis=1))
        low = np.minimum(low, label[low])
        if (low == label[some]).all():
            break
        label[some] = low
    return label


def _compared(group: pa.Table, cosine: float) -> pa.Table:
    """Links in one block of a cell, or between two: sums of linked weights, and a spanning forest.

    A pair that shares several cells is taken in the first of them.
    """
    frame = group.to_pandas().sort_values(["side", "rep"])
    cell, two = int(frame["cell"].iloc[0]), frame["i"].iloc[0] != frame["j"].iloc[0]
    unit, side = _unit(frame["vector"]), frame["side"].to_numpy()
    ids, weight = frame["rep"].to_numpy(), frame["weight"].to_numpy()
    linked = unit @ unit.T >= cosine
    linked &= (side[:, None] != side[None, :]) if two else ~np.eye(len(unit), dtype=bool)
    x, y = np.nonzero(np.triu(linked))
    cells = np.stack(frame["cells"])
    earlier = np.zeros(len(x), bool)
    for p in range(cells.shape[1]):
        own = cells[x, p]
        earlier |= (own < cell) & (cells[y] == own[:, None]).any(axis=1)
    linked[x[earlier], y[earlier]] = linked[y[earlier], x[earlier]] = False
    linked |= linked.T
    sums = linked @ weight
    root = _forest(linked)
    some = np.flatnonzero(sums > 0)
    return pa.table({"rep": ids[some], "root": ids[root[some]], "links": sums[some].astype(np.int64)})


def near_duplicates(vectors: DataFrame, params: CellParams = CellParams()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Two rows link when their labels are equal and their cosine, in double
    precision, is at least ``params.cosine``, if they share a cell: no link is
    wrong, a few may be missed. ``n_links`` counts linked rows, ``component_id`` is the
    smallest ``vec_id`` reachable, and its row is kept.

    Equal vectors of a label are one point with a weight, so copies are never
    paired. In a dense cell only counts and a spanning forest leave a task.
    Rows with a null label, ``vec_id`` or vector, a zero vector, or null or
    non-finite components link with nothing and are kept; vectors of other
    length are never compared. Rows that repeat a ``vec_id`` are one node, but
    count as rows. An empty table gives no rows.
    """
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(value, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), value.cast("array<float>").alias("vector"), (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & finite & (length > 0)
    ).alias("valid"))
    valid = rows.where("valid")
    reps = stored(valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")

    probes = stored(_assigned(reps, _centres(reps, params), params), "assigned")
    probes = probes.withColumn("cell", F.explode("cells"))
    key = ["label", "dim", "cell"]
    sizes = stored(probes.groupBy(key).agg(F.ceil(F.count("*") / params.block).cast("int").alias("blocks")), "cells")
    dealt = probes.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    sides = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.when(
                j == F.col("block"), F.array(F.struct(j.alias("i"), j.alias("j"), F.lit(0).alias("side")))
            ).otherwise(
                F.array(F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j"), (j < F.col("block")).cast("int").alias("side")))
            ),
        )
    )
    found = stored(
        dealt.withColumn("s", F.explode(sides))
        .select(*key, "s.i", "s.j", "s.side", "rep", "weight", "vector", "cells")
        .groupBy(*key, "i", "j")
        .applyInArrow(lambda group: _compared(group, params.cosine), "rep bigint, root bigint, links bigint"),
        "links",
    )
    counts = stored(found.groupBy("rep").agg(F.sum("links").alias("links")), "counts")
    components = stored(connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "components")
    judged = (
        valid.select("vec_id", "label", "vector").join(reps, ["label", "vector"])
        .join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    alone = rows.where("NOT coalesce(valid, false)").select("vec_id", F.lit(0).cast("bigint"), "vec_id")
    return judged.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

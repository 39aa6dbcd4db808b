"""Candidate models behind one small contract, and the scorers they yield."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.trees import PART, PART_SCHEMA, FlatTrees, Rule, StoredForest, binned, boost, feature_cuts, forest
from tabscope.session import shared_root
from tabscope.sources.tables import read_record, write_record

FEATURES, LABEL, WEIGHT = "#features", "#label", "#weight"
PROBABILITY = "probabilities"
#: A larger model isn't told to the tasks as a whole.
MODEL_BYTES = 256 << 20
NODES = ("feature", "threshold", "left", "right", "gains")
NODE_SCHEMA = "node long, feature int, threshold double, left int, right int, gains double, values array<double>"
#: Nodes that the driver packs as one row, which a task makes rows of.
PACKED_NODES = 20_000


class Scorer(Protocol):
    """Adds ``probabilities``, an array in class-code order, to rows with scaled features."""

    def probabilities(self, df: DataFrame) -> DataFrame: ...


class Trainer(Protocol):
    model_type: str

    def __init__(self, n_trees: int, seed: int): ...

    def fit(self, df: DataFrame) -> "TreeScorer": ...


def packed_nodes(spark: SparkSession, trees: FlatTrees) -> DataFrame:
    """Node arrays as a few rows of bytes; a row per node would take many times their size in the driver."""
    rows = []
    for first in range(0, len(trees.feature), PACKED_NODES):
        own = {name: getattr(trees, name)[first : first + PACKED_NODES] for name in PART}
        rows.append((first, len(own["feature"]), *(np.ascontiguousarray(own[name], dtype=kind).tobytes() for name, kind in PART.items())))
    return spark.createDataFrame(rows, "first long, n long, " + ", ".join(f"`{name}` binary" for name in PART))


def node_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            own = {name: np.frombuffer(r[name], dtype=kind) for name, kind in PART.items()}
            width = len(own["values"]) // r["n"]
            ends = pa.array(np.arange(r["n"] + 1, dtype=np.int32) * width, pa.int32())
            columns = [pa.array(np.arange(r["first"], r["first"] + r["n"])), *(pa.array(own[name]) for name in NODES)]
            values = pa.ListArray.from_arrays(ends, pa.array(own["values"]))
            yield pa.RecordBatch.from_arrays([*columns, values], ["node", *NODES, "values"])


@dataclass(frozen=True)
class TreeScorer:
    """Fitted trees; rows are scored by all of them at once, in batch or on a stream.

    A stored forest takes tables only: each row is dealt to its parts.
    """

    model_type: str
    trees: FlatTrees | StoredForest
    n_features: int

    def probabilities(self, df: DataFrame) -> DataFrame:
        if isinstance(self.trees, StoredForest):
            return self.trees.scored(df, vector_to_array(FEATURES), PROBABILITY)
        if self.trees.nbytes > MODEL_BYTES:
            raise ValueError(f"the model has {self.trees.nbytes} bytes, more than {MODEL_BYTES}: bound its depth or its trees")
        told = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(told.value.probabilities(np.stack(x.to_numpy()))))

        kept = [F.col(f"`{c}`") for c in df.columns]
        return df.select(*kept, score(vector_to_array(FEATURES)).alias(PROBABILITY))

    def importances(self) -> list[float]:
        """One value per feature; they add up to one unless no tree has a split."""
        return self.trees.importances(self.n_features).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        t, more = self.trees, {}
        if isinstance(t, StoredForest):
            t.parts.write.mode("overwrite").parquet(f"{path}/parts")
            more = {"stub": t.stub.tolist(), "cuts": [c.tolist() for c in t.cuts], "tree_gains": t.gains.tolist()}
            t = t.tops
        packed_nodes(spark, t).mapInArrow(node_rows, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        record = {"n_classes": t.n_classes, "boosted": t.boosted, "roots": t.roots.tolist(), "n_features": self.n_features} | more
        write_record(spark, record, f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, model_type: str, path: str) -> "TreeScorer":
        record = read_record(spark, f"{path}/trees")
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by("node")
        own = {name: nodes[name].to_numpy() for name in NODES}
        values = pc.list_flatten(nodes["values"]).to_numpy().reshape(nodes.num_rows, -1)
        roots = np.array(record["roots"], dtype=np.int32)
        trees = FlatTrees(record["n_classes"], record["boosted"], roots, values=values, **own)
        if "stub" in record:
            parts = spark.read.schema(PART_SCHEMA).parquet(f"{path}/parts")
            cuts = [np.array(c, dtype=np.float64) for c in record["cuts"]]
            trees = StoredForest(trees, np.array(record["stub"], dtype=np.int32), cuts, parts, np.array(record["tree_gains"]))
        return TreeScorer(model_type, trees, record["n_features"])


@dataclass(frozen=True)
class LibraryScorer:
    """A fitted Spark model of another library."""

    model_type: str
    model: Model

    def probabilities(self, df: DataFrame) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in df.columns]
        p = vector_to_array(self.model.getProbabilityCol())
        return self.model.transform(df).select(*kept, p.alias(PROBABILITY))

    def importances(self) -> list[float]:
        return [float(v) for v in self.model.featureImportances.toArray()]

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(path)


class TreeTrainer:
    """Bins the rows once; :meth:`grown` makes the trees."""

    def __init__(self, n_trees: int, seed: int):
        self.n_trees, self.seed = n_trees, seed

    def grown(self, blocks, n_rows: int, cuts: list[np.ndarray], n_classes: int) -> FlatTrees | StoredForest:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> TreeScorer:
        """``df``: a staged table of features, label (class codes from 0) and weight."""
        spark = df.sparkSession
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_root(spark))
        features = vector_to_array(FEATURES)
        n_rows, last, width = df.agg(F.count("*"), F.max(LABEL), F.max(F.size(features))).first()
        if not n_rows:
            raise ValueError("no rows to train on")
        cuts = feature_cuts(df, features, width)
        blocks = binned(df, features, F.col(LABEL), F.col(WEIGHT), cuts)
        trees = self.grown(blocks, n_rows, cuts, int(last) + 1)
        blocks.unpersist()
        return TreeScorer(self.model_type, trees, width)


class RandomForestTrainer(TreeTrainer):
    """A forest of unbounded depth, as a class-weighted Gini forest on bootstrap samples."""

    model_type = "random_forest"

    def grown(self, blocks, n_rows, cuts, n_classes):
        return forest(blocks, n_rows, cuts, n_classes, self.n_trees, self.seed)


class BoostedDepth6Trainer(TreeTrainer):
    """Multiclass boosting, level by level to depth 6, with an l2 penalty of 1."""

    model_type, rate = "boosted_depth6", 0.1
    rule = Rule(max_depth=6, l2=1.0, least_hessian=1.0)

    def grown(self, blocks, n_rows, cuts, n_classes):
        return boost(blocks, n_rows, cuts, n_classes, self.n_trees, self.rate, self.rule)


class BoostedLeafwiseTrainer(BoostedDepth6Trainer):
    """Multiclass boosting that always splits the leaf of the largest gain, up to 31 leaves of at least 20 rows, at any depth."""

    model_type = "boosted_leafwise"
    rule = Rule(max_leaves=31, least_rows=20, least_hessian=1e-3)


class XGBoostTrainer:
    """Multiclass boosting of the xgboost library, where it is installed."""

    model_type = "xgboost"

    def __init__(self, n_trees: int, seed: int):
        from xgboost.spark import SparkXGBClassifier

        self.estimator = SparkXGBClassifier(
            features_col=FEATURES,
            label_col=LABEL,
            weight_col=WEIGHT,
            n_estimators=n_trees,
            max_depth=6,
            learning_rate=0.1,
            random_state=seed,
        )

    def fit(self, df: DataFrame) -> LibraryScorer:
        return LibraryScorer(self.model_type, self.estimator.fit(df))


#: Libraries that could train further candidates, and what would do it; None where the trees here already grow so.
LIBRARIES: dict[str, tuple[str, type | None]] = {"xgboost": ("xgboost.spark", XGBoostTrainer), "lightgbm": ("lightgbm", None)}


def available_trainers() -> tuple[dict[str, type], dict[str, str]]:
    """Trainers by model type, and why any candidate has to be skipped."""
    own = (RandomForestTrainer, BoostedDepth6Trainer, BoostedLeafwiseTrainer)
    trainers: dict[str, type] = {t.model_type: t for t in own}
    skipped: dict[str, str] = {}
    for name, (module, trainer) in LIBRARIES.items():
        try:
            import_module(module)
        except (ImportError, OSError) as exc:  # a compiled part may be there and not load
            skipped[name] = str(exc)
            continue
        if trainer is None:
            skipped[name] = f"{module} trains on one machine; {BoostedLeafwiseTrainer.model_type} grows leaf-wise here"
        else:
            trainers[name] = trainer
    return trainers, skipped


def load_scorer(spark: SparkSession, model_type: str, path: str) -> Scorer:
    if model_type == XGBoostTrainer.model_type:
        from xgboost.spark import SparkXGBClassifierModel

        return LibraryScorer(model_type, SparkXGBClassifierModel.load(path))
    return TreeScorer.load(spark, model_type, path)

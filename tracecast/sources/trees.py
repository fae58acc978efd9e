"""Process-tree store: one row per model, the tree as JSON text.

A tree is nested JSON: ``["Seq", child, ...]`` for an operator (``Seq``, ``Xor``,
``And``, ``XorLoop``), a string for an activity, ``null`` for a silent step.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Operator names of a process tree (fixed values).
OPERATORS = ("Seq", "Xor", "And", "XorLoop")

MODEL_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType(), False),
    T.StructField("tree", T.StringType(), False),
])


def models_from(spark: SparkSession, trees: dict[str, object]) -> DataFrame:
    """Model table from trees known to the driver, e.g. ``{"m": ["Seq", "a", "b"]}``.

    Built from an Arrow table, so Catalyst knows its size and broadcasts it if small.
    """
    rows = pa.table({"model_id": list(trees), "tree": [json.dumps(t) for t in trees.values()]})
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def write_models(models: DataFrame, path: str) -> None:
    models.sort("model_id").write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(path)


def tree_from_text(text: str):
    """Loads the stored notation, e.g. ``Xor(And(Seq(1, 2), 0), tau)``."""
    quoted = re.sub(r"([^\s(),][^(),]*)", lambda m: json.dumps(m.group(1).strip()), text)
    nested = re.sub(r'"(\w+)"\(', r'["\1", ', quoted).replace(")", "]")
    return _silent(json.loads(nested))


def _silent(node):
    if isinstance(node, list):
        return [node[0], *map(_silent, node[1:])]
    return None if node == "tau" else node


def tree_to_text(tree) -> str:
    if tree is None:
        return "tau"
    if isinstance(tree, str):
        return tree
    return f"{tree[0]}({', '.join(map(tree_to_text, tree[1:]))})"

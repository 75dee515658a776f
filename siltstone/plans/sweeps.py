"""Configuration sweeps: the product of value lists, in the order of their keys."""

from __future__ import annotations

import copy
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def set_dotted(config: dict, path: str, value: Any) -> None:
    *parents, leaf = path.split(".")
    for p in parents:
        config = config.setdefault(p, {})
    config[leaf] = value


def configs(base: dict, sweep: dict[str, Any], name: str = "run") -> list[tuple[str, dict]]:
    """(run name, configuration) of each combination; a value that is no list counts as one. The base is left alone."""
    lists = {k: v if isinstance(v, list) else [v] for k, v in sweep.items()}
    out = []
    for combo in product(*lists.values()):
        own = copy.deepcopy(base)
        for k, v in zip(lists, combo):
            set_dotted(own, k, v)
        out.append((f"{name}__" + "_".join(f"{k}={v}" for k, v in zip(lists, combo)) if lists else name, own))
    return out


def flatten(config: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted keys of a nested dictionary."""
    out = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def expand(spark: SparkSession, name: str, sweep: dict[str, Any]) -> DataFrame:
    """run_name and values (a map of the dotted keys to their text), a row a combination."""
    rows = [(run, {k: str(v) for k, v in flatten(c).items()}) for run, c in configs({}, sweep, name)]
    return spark.createDataFrame(rows, "run_name string, values map<string,string>")

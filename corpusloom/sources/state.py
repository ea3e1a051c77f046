"""Sampler position, saved and restored."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.manifest import put_new
from corpusloom.sources.token_shards import filesystem, qualified

STATE_SCHEMA = "step bigint, epoch int, index bigint, seed bigint, num_samples bigint"

# Fixed name pattern of a saved state.
STATE_NAME = r"^step_(\d+)\.pt$"


@dataclass(frozen=True)
class SamplerState:
    """Position in the run: reading samples doesn't move it, ``advance`` does."""

    seed: int
    num_samples: int
    epoch: int = 0
    index: int = 0

    def advance(self, n: int) -> SamplerState:
        return replace(self, index=self.index + n)

    def next_epoch(self) -> SamplerState:
        return replace(self, epoch=self.epoch + 1, index=0)


def save_state(spark: SparkSession, path: str, step: int, state: SamplerState) -> None:
    """Appends one row to the state table."""
    row = (step, state.epoch, state.index, state.seed, state.num_samples)
    spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, seed: int, num_samples: int) -> tuple[int, SamplerState] | None:
    """(step, state) of the highest step, None without any; it must belong to the same run."""
    try:
        saved = spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = saved.agg(F.max_by(F.struct(*saved.columns), "step").alias("s")).first()["s"]
    if row is None:
        return None
    for name, found, expected in (
        ("seed", row["seed"], seed),
        ("num_samples", row["num_samples"], num_samples),
    ):
        if found != expected:
            raise ValueError(f"Saved sampler state has another {name}: {found}, current {expected}")
    return row["step"], SamplerState(row["seed"], row["num_samples"], row["epoch"], row["index"])


def step_of(name: Column) -> Column:
    """Step number in a state's name; null for other names. Compared as a number, not as text."""
    digits = F.regexp_extract(name, STATE_NAME, 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def latest_states(states: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Highest step per group and its name; null where no name is a state's."""
    step = step_of(F.col(name))
    return states.groupBy(*by).agg(
        F.max(step).alias("step"), F.max_by(F.when(step.isNotNull(), F.col(name)), step).alias(name)
    )


class StepTaken(Exception):
    """Another writer saved a state of this step first."""


class StateStore:
    """States in files of their own, one per step, each put whole or not at all.

    The newest is found by the files' names alone. Two writers can't both save a
    step: the second is refused, so a run that was started twice is noticed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.fs, self.root = filesystem(qualified(spark, path))

    def steps(self) -> list[int]:
        """Saved steps, ascending; compared as numbers."""
        if self.fs.get_file_info(self.root).type != pafs.FileType.Directory:
            return []
        names = (i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.root)))
        return sorted(int(m[1]) for m in map(re.compile(STATE_NAME).match, names) if m)

    def save(self, step: int, state: SamplerState) -> None:
        if step < 0:
            raise ValueError(f"A step must not be negative: {step}")
        self.fs.create_dir(self.root, recursive=True)
        try:
            put_new(self.fs, f"{self.root}/step_{step}.pt", json.dumps(asdict(state)).encode())
        except FileExistsError as error:
            raise StepTaken(f"Step {step} was saved already in {self.root}") from error

    def load(self, seed: int, num_samples: int, step: int | None = None) -> tuple[int, SamplerState] | None:
        """(step, state) of the newest step or the one asked for; it must belong to the same run."""
        known = self.steps()
        wanted = known[-1] if step is None and known else step
        if wanted not in known:
            return None
        with self.fs.open_input_file(f"{self.root}/step_{wanted}.pt") as f:
            state = SamplerState(**json.loads(f.read()))
        for name, found, expected in (("seed", state.seed, seed), ("num_samples", state.num_samples, num_samples)):
            if found != expected:
                raise ValueError(f"Saved sampler state has another {name}: {found}, current {expected}")
        return wanted, state

    def resume(self, seed: int, num_samples: int) -> SamplerState:
        """Where to go on: the newest state, or the run's beginning."""
        found = self.load(seed, num_samples)
        return found[1] if found else SamplerState(seed, num_samples)

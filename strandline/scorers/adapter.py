"""Scorers that users bring as plain Python objects."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .base import Scorer


class Scores(Protocol):
    """What an object needs: rewards of prompts and sequences, in their order."""

    def score_batch(self, prompts: list[str], sequences: list[str]) -> list[float]: ...


class ObjectScorer(Scorer):
    """Rewards by an object's score_batch, called with batches of rows where they are.

    The object is pickled once and broadcast, and each worker unpickles it once.
    A batch that raises, or gives another number of rewards, is scored again row
    by row: rows that still fail have a reward of null and their error. Null
    prompts and sequences are given as ''.
    """

    def __init__(self, scorer: Scores, batch_rows: int = 256):
        from pyspark import cloudpickle

        self.raw, self.batch_rows = cloudpickle.dumps(scorer), batch_rows

    def detail(self, pairs: DataFrame) -> DataFrame:
        """id, reward, error."""
        shared, rows = SparkSession.active().sparkContext.broadcast(self.raw), self.batch_rows

        def rewards(scorer: Scores, prompts: list[str], sequences: list[str]) -> list[float]:
            got = [float(x) for x in scorer.score_batch(prompts, sequences)]
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} rewards for {len(prompts)} pairs")
            return got

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = None
            for batch in batches:
                scorer = pickle.loads(shared.value) if scorer is None else scorer
                for at in range(0, len(batch), rows):
                    part = batch.slice(at, rows)
                    prompts, sequences = ([x or "" for x in part.column(i).to_pylist()] for i in (1, 2))
                    try:
                        got, errors = rewards(scorer, prompts, sequences), [None] * len(part)
                    except Exception:  # one row's fault is not its neighbours'
                        got, errors = [], []
                        for p, s in zip(prompts, sequences, strict=True):
                            try:
                                got.append(rewards(scorer, [p], [s])[0])
                                errors.append(None)
                            except Exception as e:
                                got.append(None)
                                errors.append(f"{type(e).__name__}: {e}")
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64()), pa.array(errors, pa.string())], ["id", "reward", "error"])

        picked = pairs.select("id", "prompt", "sequence")
        return picked.mapInArrow(run, T.StructType([picked.schema["id"]]).add("reward", T.DoubleType()).add("error", T.StringType()))

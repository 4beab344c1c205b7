"""Hooks for models: one client a partition, plain functions in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship_package

# Sampling temperature of each stage's calls.
TEMPERATURE = {"merge": 0.1, "split": 0.1, "translate": 0.3, "review": 0.2, "describe": 0.15, "thumbnails": 0.2, "choose": 0.1, "refine": 0.2}


#: Values that answers may hold together (characters, samples, entries) before they leave a task.
HELD = 2_000_000


def _held(answer: dict) -> int:
    return 1 + sum(len(v) for v in answer.values() if hasattr(v, "__len__"))


def _mapped(rows: DataFrame, make: Callable[[], Callable], schema: str, columns: list[str], keep: list[str], held: int = HELD) -> DataFrame:
    """Answers leave in pieces of about ``held`` values, or one answer, however many rows a batch has."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in batches:
            kept, answers, begun, size = batch[keep], [], 0, 0
            for at, row in enumerate(batch.to_dict("records"), 1):
                answers.append(call(row))
                size += _held(answers[-1])
                if size >= held or at == len(batch):
                    yield kept.iloc[begun:at].assign(**{c: [a.get(c) for a in answers] for c in columns})
                    answers, begun, size = [], at, 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInPandas(run, f"{fields}, {schema}")


def map_model(requests: DataFrame, make: Callable[[], Callable], stage: str) -> DataFrame:
    """``raw, input_tokens, output_tokens`` beside each request; ``make()`` gives a partition's client ``row -> dict``."""
    warm = TEMPERATURE[stage]
    client = lambda: (lambda call: lambda row: call({**row, "temperature": warm}))(make())
    return _mapped(requests, client, "raw string, input_tokens bigint, output_tokens bigint", ["raw", "input_tokens", "output_tokens"], requests.columns)


def map_recognise(gaps: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """``segments array<struct<start,end,text>>`` of each gap, for recovery."""
    return _mapped(gaps, make, "segments array<struct<start:double,end:double,text:string>>", ["segments"], gaps.columns)


def map_synthesise(pending: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """``samples, sample_rate, actual_dur`` of each cue to speak."""

    def timed():
        call = make()

        def run(row):
            out = call(row)
            return {**out, "actual_dur": len(out["samples"]) / out["sample_rate"]}

        return run

    return _mapped(pending, timed, "samples array<float>, sample_rate int, actual_dur double", ["samples", "sample_rate", "actual_dur"], pending.columns)

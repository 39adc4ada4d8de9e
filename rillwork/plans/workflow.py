"""Pipelines as data: readers, operators and writers by name.

    {"engines": [{"id": 1, "readers": [{"reader": "file", "paths": ["in"], "kind": "PARQUET"}],
                  "operators": [{"op": "filter_rows", "column": "x", "condition": "LESS_THAN", "value": 10}],
                  "writers": [{"writer": "file", "path": "out", "kind": "PARQUET"}]}]}

A batch engine makes one lazy plan per pipeline and runs one action per writer; a streaming
engine starts one query per writer. Engines run in the order of their `prev` links.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError
from ..registry import build
from ..sources import readers as readers_of
from ..sources import writers as writers_of
from ..sources.http import register_http

READERS = {"file": readers_of.file_reader, "privacy_file": readers_of.privacy_reader, "table": readers_of.table_reader, "sql": readers_of.sql_reader, "connector": readers_of.connector_reader, "kafka": readers_of.kafka_reader, "kafka_pipe": readers_of.kafka_pipe_reader, "file_pipe": readers_of.file_pipe_reader}
WRITERS = {"file": writers_of.file_writer, "table": writers_of.table_writer, "connector": writers_of.connector_writer, "kafka": writers_of.kafka_writer, "http": writers_of.http_writer, "stdout": writers_of.stdout_writer, "console_pipe": writers_of.console_pipe, "file_pipe": writers_of.file_pipe, "kafka_pipe": writers_of.kafka_pipe, "memory_pipe": writers_of.memory_pipe, "connector_pipe": writers_of.connector_pipe}


@dataclass(frozen=True)
class Engine:
    id: int
    readers: tuple[dict, ...] = ()
    operators: tuple[dict, ...] = ()
    writers: tuple[dict, ...] = ()
    prev: int | None = None
    strict: bool = True

    def frame(self, spark: SparkSession) -> DataFrame:
        """The plan: all readers feed the first operator, the rest is a chain."""
        frames = [_made(READERS, "reader", r)(spark) for r in self.readers]
        if not frames:
            raise ValidationError(f"engine {self.id} reads nothing")
        for o in self.operators:
            o = dict(o)
            frames = [build(o.pop("op"), strict=self.strict, **o)(*frames)]
        if len(frames) != 1:
            raise ValidationError(f"engine {self.id} has {len(frames)} inputs and no operator that joins them")
        return frames[0]

    def run(self, spark: SparkSession, every: str | None = None) -> list:
        """Run the writers; streaming ones that name no trigger of their own are triggered `every` so often (None: once)."""
        df = self.frame(spark)
        return [_made(WRITERS, "writer", {"trigger": every} | w if w["writer"].endswith("_pipe") else w)(df) for w in self.writers]


def _multiple(readers: list[dict], **options):
    return readers_of.multiple_readers([_made(READERS, "reader", r) for r in readers], **options)


def _http(**options):
    def read(spark: SparkSession) -> DataFrame:
        register_http(spark)
        return spark.read.format("http_poll").options(**options).load()

    return read


def _batch_pipe(to: list[dict], **options):
    """Every micro-batch to each of several batch writers."""
    made = [_made(WRITERS, "writer", w) for w in to]
    return writers_of.batch_pipe(lambda df, batch: [w(df) for w in made] and None, **options)


READERS |= {"multiple": _multiple, "http": _http}
WRITERS |= {"batch_pipe": _batch_pipe}


def _made(kinds: dict, what: str, params: dict):
    params = dict(params)
    name = params.pop(what)
    if name not in kinds:
        raise ValidationError(f"unknown {what} {name!r}")
    return kinds[name](**params)


@dataclass(frozen=True)
class Workflow:
    engines: tuple[Engine, ...]
    run_type: dict = field(default_factory=lambda: {"kind": "ONCE"})

    @staticmethod
    def load(text: str | dict) -> Workflow:
        data = json.loads(text) if isinstance(text, str) else text
        engines = tuple(Engine(e["id"], tuple(e.get("readers", ())), tuple(e.get("operators", ())), tuple(e.get("writers", ())), e.get("prev"), e.get("strict", True)) for e in data["engines"])
        return Workflow(engines, data.get("run_type", {"kind": "ONCE"}))

    def ordered(self) -> list[Engine]:
        done: list[Engine] = []
        left = list(self.engines)
        while left:
            ready = [e for e in left if e.prev is None or e.prev in {d.id for d in done}]
            if not ready:
                raise ValidationError("the engines' links form a circle or lead nowhere")
            done += ready
            left = [e for e in left if e not in ready]
        return done

    def trigger(self) -> dict:
        """How a streaming writer is to be triggered: once over what is there, or every so often."""
        return {"ONCE": {"availableNow": True}, "EVERY_MINUTE": {"processingTime": "1 minute"}}.get(self.run_type.get("kind", "ONCE"), {"processingTime": self.run_type.get("period", "1 minute")})

    def run(self, spark: SparkSession) -> list:
        """Run all engines; streaming queries of earlier engines are awaited where they end by themselves."""
        out = []
        for e in self.ordered():
            made = e.run(spark, self.trigger().get("processingTime"))
            for q in made:
                if q is not None and self.run_type.get("kind", "ONCE") == "ONCE":
                    q.awaitTermination()
            out += made
        return out

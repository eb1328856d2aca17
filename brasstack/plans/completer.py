"""Model calls stay outside the engine: a completer turns prompts into outputs; the offline one replays a table."""

from __future__ import annotations

import random
import time
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Completer(Protocol):
    def complete(self, prompts: DataFrame) -> DataFrame:
        """prompts (key, prompt) to key, raw_output, error."""


class Replay:
    """Outputs recorded earlier, by key; what is missing comes back as an error, so callers skip and count it."""

    def __init__(self, outputs: DataFrame):
        self.outputs = outputs

    def complete(self, prompts: DataFrame) -> DataFrame:
        met = prompts.join(self.outputs.select("key", "raw_output"), "key", "left")
        return met.withColumn("error", F.when(F.col("raw_output").isNull(), "no recorded output"))


class Throttle:
    """At most `rate` calls in any `period` seconds, `rate` of them at once."""

    def __init__(self, rate: float, period: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.period, self.clock, self.sleep = max(rate, 1e-9), period, clock, sleep
        self.level, self.at = 0.0, clock()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            self.level = max(0.0, self.level - (now - self.at) * self.rate / self.period)
            self.at = now
            if self.level + 1 <= max(self.rate, 1.0) + 1e-9:
                self.level += 1
                return
            self.sleep((self.level + 1 - max(self.rate, 1.0)) * self.period / self.rate)


def attempts(call, tries: int = 5, first: float = 1.0, most: float = 60.0, jitter: float = 1.0, sleep=time.sleep, rng=random.random):
    """call() until it succeeds, `tries` times at most; waits double from `first` up to `most`, with jitter. The last error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - any failure of a remote call may pass
            if k + 1 == tries:
                raise
            sleep(min(most, first * 2**k + rng() * jitter))


class PerPartition:
    """Calls a client made once a partition; failures stay in their row, after retries.

    partitions bounds the calls at one time; each partition has an equal share of the provider's calls a minute.
    """

    def __init__(self, make_client, partitions: int = 5, per_minute: float | None = None, tries: int = 5, first: float = 1.0, most: float = 60.0):
        self.make_client, self.partitions, self.per_minute, self.retry = make_client, partitions, per_minute, (tries, first, most)

    def complete(self, prompts: DataFrame) -> DataFrame:
        make, share, (tries, first, most) = self.make_client, self.per_minute and self.per_minute / self.partitions, self.retry

        def run(frames):
            client, gate = make(), Throttle(share) if share else None

            def ask(prompt):
                if gate:
                    gate.acquire()
                return client(prompt)

            for f in frames:
                rows = []
                for key, prompt in zip(f["key"], f["prompt"]):
                    try:
                        rows.append((key, prompt, attempts(lambda p=prompt: ask(p), tries, first, most, jitter=min(1.0, first)), None))
                    except Exception as e:  # noqa: BLE001 - one call's failure must not end the batch
                        rows.append((key, prompt, None, str(e)[:500]))
                yield pd.DataFrame(rows, columns=["key", "prompt", "raw_output", "error"])

        return prompts.select("key", "prompt").repartition(self.partitions).mapInPandas(run, "key string, prompt string, raw_output string, error string")


def request_parameters(model, max_tokens: int, temperature):
    """Parameters by model name: reasoning models take max_completion_tokens and no temperature; a temperature of 0 is left out for claude names."""
    reasoning = F.regexp_like(model, F.lit("^(o1|o3|gpt-5)"))
    limit = F.when(reasoning, F.create_map(F.lit("max_completion_tokens"), F.lit(float(max_tokens)))).otherwise(F.create_map(F.lit("max_tokens"), F.lit(float(max_tokens))))
    heat = reasoning | (model.startswith("claude") & (F.lit(temperature) == 0))
    return F.when(heat, limit).otherwise(F.map_concat(limit, F.create_map(F.lit("temperature"), F.lit(float(temperature)))))

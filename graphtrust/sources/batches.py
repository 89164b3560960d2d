"""Batch labelling through a service: count and price requests, submit below a cap, fetch replies. The service is a parameter."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: States of a batch after which nothing more comes.
ENDED = ("completed", "failed", "expired", "cancelled")


class Service(Protocol):
    """What a batch service must offer; clients and credentials are its own."""

    def submit(self, path: str) -> str:
        """Send a file of requests; the batch's id."""

    def status(self, batch: str) -> str:
        """Its state, one of ENDED at last."""

    def fetch(self, batch: str, path: str) -> None:
        """Write its replies as JSON lines to a path that Spark can read."""


@dataclass(frozen=True)
class Prices:
    """Tokens of a request and of its reply on average, and dollars for a million of either."""

    tokens_in: float
    tokens_out: float
    million_in: float
    million_out: float

    def cost(self, requests: int) -> float:
        return requests * (self.tokens_in * self.million_in + self.tokens_out * self.million_out) / 1e6


class OverCap(RuntimeError):
    """A batch would cost more than its cap."""


def count_requests(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).filter(F.col("value").rlike(r"\S")).count()


def submit(spark: SparkSession, path: str, prices: Prices, cap: float, service: Service | None = None) -> dict:
    """Submit a file of requests, or without a service only price it (a dry run). Above the cap nothing is sent: OverCap."""
    n = count_requests(spark, path)
    record = {"path": path, "requests": n, "cost": prices.cost(n), "cap": cap, "executed": service is not None}
    if record["cost"] > cap:
        raise OverCap(f"{n} requests at about {record['cost']:.2f} are above the cap of {cap:.2f}")
    if service:
        record["batch"] = service.submit(path)
    return record


def retrieve(service: Service, batch: str, path: str, most: int = 1, pause: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask for a batch's state up to `most` times and fetch the replies of a completed one; the last state."""
    state = service.status(batch)
    for _ in range(most - 1):
        if state in ENDED:
            break
        sleep(pause)
        state = service.status(batch)
    if state == "completed":
        service.fetch(batch, path)
    return state


def required(name: str) -> str:
    """An environment variable that must be set and not be empty."""
    if not (value := os.environ.get(name)):
        raise RuntimeError(f"environment variable {name} is not set")
    return value

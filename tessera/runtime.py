"""Settings, timers and reuse of computed tables."""

from __future__ import annotations

import contextlib
import logging
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

log = logging.getLogger("tessera")


@dataclass(frozen=True)
class Config:
    """Settings of cross-validation and grids: fits side by side, and whether scores are better when higher."""

    higher_is_better: bool = True
    parallel: int = 4


_config = Config()


def config() -> Config:
    return _config


@contextlib.contextmanager
def configured(**changes):
    """Other settings inside a block."""
    global _config
    before, _config = _config, replace(_config, **changes)
    try:
        yield _config
    finally:
        _config = before


@contextlib.contextmanager
def timed(name: str):
    """Log how long a block took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s took %.2f s", name, time.perf_counter() - began)


class PlanCache:
    """Persisted tables by the meaning of their plans; the oldest go when there are more than `limit`."""

    def __init__(self, limit: int = 16):
        self.limit, self.kept = limit, {}

    def get(self, df: DataFrame) -> DataFrame:
        key = df.semanticHash()
        if key not in self.kept:
            if len(self.kept) >= self.limit:
                self.kept.pop(next(iter(self.kept))).unpersist()
            self.kept[key] = df.persist()
        return self.kept[key]

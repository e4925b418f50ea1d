"""Pluggable measurement pillars: any DataFrame-to-DataFrame function under a backend name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

Pillar = Callable[[DataFrame], DataFrame]


class Pillars:
    """Backends of one pillar. An unknown name leaves every shot NOT_COMPUTED."""

    def __init__(self, key: str, schema: StructType, absent_reason: str):
        self.key, self.schema, self.absent_reason = key, schema, absent_reason
        self._known: dict[str, Pillar] = {}

    def register(self, backend: str, fn: Pillar) -> None:
        self._known[backend] = fn

    def __call__(self, backend: str) -> Pillar:
        """A function for ``DataFrame.transform`` that ends in the declared columns."""
        fn = self._known.get(backend)

        def run(df: DataFrame) -> DataFrame:
            if fn is None:
                blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
                return df.select(self.key, F.lit("NOT_COMPUTED").alias("status"), F.lit(self.absent_reason).alias("reason_code"), *blank)
            out = fn(df)
            return out.select(self.key, "status", "reason_code", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

        return run

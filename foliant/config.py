"""Settings that define results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    # Chunking.
    chunk_token_target: int = 512
    chunk_token_cap: int = 800
    # Layout.
    space_gap_ratio: float = 0.30
    long_token: int = 28
    margin_top: float = 0.12
    margin_bottom: float = 0.88
    furniture_key_chars: int = 160
    repeat_page_fraction: float = 0.30
    # Retrieval and embedding.
    top_k: int = 8
    embed_model: str = "BGE-M3"
    embed_dim: int = 1024
    embed_batch: int = 16
    # Salary grids.
    payments: int = 14
    header_rows: int = 12
    # Answers.
    synthesis_tokens: int = 1024
    router_tokens: int = 512
    ground_tokens: int = 4096
    ground_tokens_retry: int = 8192
    answer_provider: str = "stub"
    answer_model: str = "stub"
    answer_endpoint: str = "http://localhost"
    router_model: str = "stub-small"
    router_endpoint: str = ""
    # Objects.
    image_dpi: int = 150
    self_retrieval_gate: float = 0.85

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The defaults, overridden by spark.foliant.<name>."""
        found = {f.name: spark.conf.get(f"spark.foliant.{f.name}", None) for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in found.items() if v is not None})

    def public(self, spark: SparkSession) -> DataFrame:
        """The settings as one row, the router's endpoint falling back to the answer's."""
        row = {f.name: getattr(self, f.name) for f in fields(self)}
        row["router_endpoint"] = row["router_endpoint"] or row["answer_endpoint"]
        return spark.createDataFrame([row])


DEFAULT = Settings()

"""Scorers: columns of candidates in, score columns out.

A scorer is anything with ``edge_columns(df)`` and ``attach_column(df)``. The edge
input has query, cur_eff, dst_eff, dst_summary, dst_full, edge_vector, path,
confidence and hop; the output has the six scores. All of a row's similarities
are worked out in one Arrow batch (functions/batch.py), the neural ones too (models.py).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from nodeweave.functions import batch as B
from nodeweave.functions.vectors import clamp01

SCORES = ("follow", "read_full", "include", "expand", "stop", "result")


class Scorer(Protocol):
    def edge_columns(self, df: DataFrame) -> DataFrame: ...

    def attach_column(self, df: DataFrame) -> DataFrame: ...


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def _blend(q2d: np.ndarray, c2d: np.ndarray, q2e: np.ndarray, p2d: np.ndarray, conf: np.ndarray, hop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(follow, include by summary, expand) of the five similarities."""
    follow = _clip(0.50 * q2d + 0.15 * c2d + 0.20 * q2e + 0.05 * p2d + 0.10 * conf - 0.03 * hop)
    return follow, _clip(0.80 * q2d + 0.10 * q2e + 0.10 * conf), _clip(0.80 * follow + 0.20 * c2d - 0.05 * hop)


@dataclass(frozen=True)
class HeuristicScorer:
    """Weighted similarities of query, edge, path and nodes."""

    edge_dims: int = 16

    def edge_columns(self, df: DataFrame) -> DataFrame:
        dims = self.edge_dims

        def score(query, cur, dst, full, edge, path, conf, hop) -> dict[str, np.ndarray]:
            q2d, c2d = B.cosine01(query, dst), B.cosine01(cur, dst)
            q2e, p2d = B.cosine01(B.resize(query, dims), edge), B.cosine01(path, dst)
            follow, summary, expand = _blend(q2d, c2d, q2e, p2d, conf, hop)
            include = np.where(full.there, _clip(0.55 * summary + 0.45 * B.cosine01(query, full)), summary)
            read_full = np.where(full.there, _clip(0.75 * summary + 0.25 * follow), summary)
            return {"follow": follow, "read_full": read_full, "include": include, "expand": expand, "stop": _clip(1.0 - expand), "result": _clip(0.80 * include + 0.15 * read_full + 0.05 * follow)}

        return B.with_scores(df, ["query", "cur_eff", "dst_eff", "dst_full", "edge_vector", "path"], ["confidence", "hop"], SCORES, score)

    def attach_column(self, df: DataFrame) -> DataFrame:
        """attach from new_eff, cand_eff, new_full, cand_full, new_summary, cand_summary, path; the full match falls back to the summaries where either full vector is missing."""

        def score(new, cand, new_full, cand_full, new_summary, cand_summary, path) -> dict[str, np.ndarray]:
            full = np.where(new_full.there & cand_full.there, B.cosine01(new_full, cand_full), B.cosine01(new_summary, cand_summary))
            return {"attach": _clip(0.60 * B.cosine01(new, cand) + 0.30 * full + 0.10 * B.cosine01(path, cand))}

        return B.with_scores(df, ["new_eff", "cand_eff", "new_full", "cand_full", "new_summary", "cand_summary", "path"], [], ["attach"], score)


@dataclass(frozen=True)
class RelationScorer:
    """One score led by the edge's own vector; never expands."""

    def edge_columns(self, df: DataFrame) -> DataFrame:
        def score(query, edge, dst, path, conf) -> dict[str, np.ndarray]:
            s = _clip(0.68 * B.cosine01(query, edge) + 0.18 * B.cosine01(query, dst) + 0.04 * B.cosine01(path, dst) + 0.10 * conf)
            return {n: s for n in ("follow", "read_full", "include", "result")} | {"expand": np.zeros(len(s)), "stop": np.ones(len(s))}

        return B.with_scores(df, ["query", "edge_vector", "dst_summary", "path"], ["confidence"], SCORES, score)

    def attach_column(self, df: DataFrame) -> DataFrame:
        """attach from new_route, cand_route, new_summary, cand_summary and path."""

        def score(new, cand, new_summary, cand_summary, path) -> dict[str, np.ndarray]:
            return {"attach": _clip(0.70 * B.cosine01(new, cand) + 0.20 * B.cosine01(new_summary, cand_summary) + 0.10 * B.cosine01(path, cand_summary))}

        return B.with_scores(df, ["new_route", "cand_route", "new_summary", "cand_summary", "path"], [], ["attach"], score)


@dataclass(frozen=True)
class FixedScorer:
    """Scores looked up by destination, with a default row: for tests and replay."""

    table: DataFrame

    def edge_columns(self, df: DataFrame) -> DataFrame:
        got = df.join(self.table.withColumnRenamed("dst_id", "_dst"), F.col("dst_id") == F.col("_dst"), "left").drop("_dst")
        default = {"follow": 0.1, "read_full": 0.1, "include": 0.1, "expand": 0.0, "stop": 1.0, "result": 0.1}
        return got.select(*df.columns, *[F.coalesce(F.col(s), F.lit(default[s])).alias(s) for s in SCORES])

    def attach_column(self, df: DataFrame) -> DataFrame:
        return df.withColumn("attach", F.lit(0.1))


@dataclass
class CountingScorer:
    """A scorer that also counts: calls, and the candidates its plans scored (once they have run)."""

    inner: Scorer
    observed: list = field(default_factory=list)

    def _counted(self, df: DataFrame) -> DataFrame:
        self.observed.append(Observation())
        return df.observe(self.observed[-1], F.count(F.lit(1)).alias("n"))

    def edge_columns(self, df: DataFrame) -> DataFrame:
        return self._counted(self.inner.edge_columns(df))

    def attach_column(self, df: DataFrame) -> DataFrame:
        return self._counted(self.inner.attach_column(df))

    def counts(self) -> dict[str, int]:
        """Waits for plans that have not run yet."""
        return {"calls": len(self.observed), "candidates": sum(o.get["n"] for o in self.observed)}


def edge_targets(df: DataFrame, edge_dims: int = 16) -> DataFrame:
    """Training targets of raw summaries: query, current_summary, edge, dst_summary, path, confidence, hop."""

    def score(query, cur, edge, dst, path, conf, hop) -> dict[str, np.ndarray]:
        follow, include, expand = _blend(B.cosine01(query, dst), B.cosine01(cur, dst), B.cosine01(B.resize(query, edge_dims), edge), B.cosine01(path, dst), conf, hop)
        return {"follow": follow, "include": include, "read_full": _clip(0.75 * include + 0.25 * follow), "expand": expand, "stop": _clip(1.0 - expand)}

    return B.with_scores(df, ["query", "current_summary", "edge", "dst_summary", "path"], ["confidence", "hop"], ("follow", "include", "read_full", "expand", "stop"), score)


def attach_gate(summary: Column, full: Column, path: Column) -> Column:
    """Attach target: both similarities must hold, the path may only add to what they allow."""
    gate = F.least(summary, full)
    return clamp01(0.70 * gate + 0.20 * summary * full + 0.10 * F.least(path, gate))


def bootstrap_teacher(df: DataFrame, edge_dims: int = 16) -> DataFrame:
    """Teacher scores from same_topic (0 or 1) and similarities; input as for edge_columns."""

    def score(query, cur, dst, edge, path, conf, topic) -> dict[str, np.ndarray]:
        q, e, p, c = B.cosine01(query, dst), B.cosine01(B.resize(query, edge_dims), edge), B.cosine01(path, dst), B.cosine01(cur, dst)
        include = _clip(0.65 * topic + 0.25 * q + 0.10 * p)
        expand = _clip(0.50 * topic + 0.20 * c + 0.20 * conf + 0.10 * e)
        read_full = _clip(0.45 * (1.0 - 2.0 * np.abs(q - 0.5)) + 0.25 * (1.0 - topic) + 0.30 * include)
        return {"follow": _clip(0.58 * topic + 0.22 * q + 0.12 * e + 0.08 * conf), "include": include, "expand": expand, "read_full": read_full, "stop": _clip(1.0 - expand)}

    return B.with_scores(df, ["query", "cur_eff", "dst_eff", "edge_vector", "path"], ["confidence", "same_topic"], ("follow", "include", "expand", "read_full", "stop"), score)

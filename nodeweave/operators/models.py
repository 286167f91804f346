"""Neural scorers for edges and for attaching: numpy forward passes over Arrow batches, weights sent once to each executor."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.functions.batch import Rows, resize, with_scores
from nodeweave.functions.vectors import col
from nodeweave.operators.scorers import SCORES


#: Rows that a model works on at once: the tokens and hidden layers of a whole Arrow batch of 10,000 rows take gigabytes.
BLOCK_ROWS = 64


def in_blocks(score: Callable[..., dict[str, np.ndarray]], rows: int = BLOCK_ROWS) -> Callable[..., dict[str, np.ndarray]]:
    """``score`` over every row, a block at a time; its memory grows with the block and not with the batch."""

    def run(*given: Rows | np.ndarray) -> dict[str, np.ndarray]:
        starts = range(0, len(given[0].x), rows) or [0]
        got = [score(*[_cut(g, slice(i, i + rows)) for g in given]) for i in starts]
        return {name: np.concatenate([g[name] for g in got]) for name in got[0]}

    return run


def _cut(g: Rows | np.ndarray, at: slice) -> Rows | np.ndarray:
    return Rows(g.x[at], g.size[at], g.there[at]) if isinstance(g, Rows) else g[at]


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function, by a rational approximation of erf good to 1.5e-7."""
    z = np.abs(x)
    z *= 1 / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    z *= z
    y = np.exp(np.negative(z, out=z), out=z)
    p = 1.061405429 * t
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        p += c
        p *= t
    p *= y
    erf = np.copysign(np.subtract(1, p, out=p), x, out=p)
    erf += 1
    erf *= x
    erf *= 0.5
    return erf


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fold_rows(x: np.ndarray, dims: int) -> np.ndarray:
    """Fold-resize of every row; rows of that length are left as they are."""
    return resize(Rows(x, np.full(len(x), x.shape[1]), np.ones(len(x), bool)), dims).x


def _layer(rng: np.random.Generator, rows: int, cols: int) -> dict[str, np.ndarray]:
    bound = 1 / math.sqrt(cols)
    return {"w": rng.uniform(-bound, bound, (rows, cols)), "b": rng.uniform(-bound, bound, rows)}


def linear(p: dict, x: np.ndarray) -> np.ndarray:
    """One product for all tokens of all rows."""
    y = x.reshape(-1, x.shape[-1]) @ p["w"].T
    y += p["b"]
    return y.reshape(*x.shape[:-1], len(p["b"]))


def layer_norm(p: dict, x: np.ndarray) -> np.ndarray:
    m = x.mean(-1, keepdims=True)
    v = ((x - m) ** 2).mean(-1, keepdims=True)
    return (x - m) / np.sqrt(v + 1e-5) * p["w"] + p["b"]


def compared(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Product and distance of each pair, the first folded to the second's length."""
    out = []
    for a, b in pairs:
        a = fold_rows(a, b.shape[1])
        out += [a * b, np.abs(a - b)]
    return out


def edge_parts(parts: list[np.ndarray]) -> list[np.ndarray]:
    """All features of an edge in the fixed order of trained weights."""
    query, current, edge, dst, path, scalars = parts
    return [*parts, *compared((query, dst), (current, dst), (path, dst), (query, edge))]


def attach_parts(parts: list[np.ndarray]) -> list[np.ndarray]:
    """All features of a new node and its candidate in the fixed order of trained weights."""
    new, cand, new_full, cand_full, path = parts
    return [*parts, *compared((new, cand), (new_full, cand_full), (path, cand))]


def perceptron(w: dict, features: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(features, axis=1)
    return sigmoid(linear(w["l2"], gelu(linear(w["l1"], gelu(linear(w["l0"], x))))))


def encoder(w: dict, x: np.ndarray, heads: int) -> np.ndarray:
    """Post-norm self-attention layers over (rows, tokens, width), of which the first token is returned: the last layer works out no other."""
    n, t, h = x.shape
    names = sorted(w["layers"], key=int)

    def split(y: np.ndarray) -> np.ndarray:
        return y.reshape(n, y.shape[1], heads, h // heads).transpose(0, 2, 1, 3)

    for name in names:
        p = w["layers"][name]
        asked = x[:, :1] if name == names[-1] else x
        q, k, v = split(linear(p["q"], asked)), split(linear(p["k"], x)), split(linear(p["v"], x))
        a = q @ k.transpose(0, 1, 3, 2) / math.sqrt(h // heads)
        a = np.exp(a - a.max(-1, keepdims=True))
        mixed = ((a / a.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(asked.shape)
        x = layer_norm(p["n1"], asked + linear(p["o"], mixed))
        x = layer_norm(p["n2"], x + linear(p["f2"], gelu(linear(p["f1"], x))))
    return x[:, 0]


#: Which projection makes a token of each feature.
EDGE_TOKENS = ("query", "summary", "edge", "summary", "path", "scalar", *["summary"] * 6, *["edge"] * 2)
ATTACH_TOKENS = ("summary", "summary", "full", "full", "path", "summary", "summary", "full", "full", "summary", "summary")


def mixed_tokens(w: dict, features: list[np.ndarray], kinds: tuple[str, ...], heads: int) -> np.ndarray:
    """What the encoder makes of the first token, over one token for each feature."""
    tokens = [linear(w[k], f) for k, f in zip(kinds, features)]
    x = np.stack([np.broadcast_to(w["cls"], tokens[0].shape), *tokens], axis=1) + w["types"]
    return encoder(w, x, heads)


def transformer_edge(w: dict, features: list[np.ndarray], heads: int) -> np.ndarray:
    return sigmoid(linear(w["out"], layer_norm(w["norm"], mixed_tokens(w, features, EDGE_TOKENS, heads))))


def transformer_attach(w: dict, features: list[np.ndarray], heads: int) -> np.ndarray:
    """The plain head, or the hybrid one if the weights hold a projection of the explicit features."""
    x = mixed_tokens(w, features, ATTACH_TOKENS, heads)
    if "explicit0" not in w:
        return sigmoid(linear(w["out"], layer_norm(w["norm"], x)))
    explicit = gelu(linear(w["explicit1"], gelu(linear(w["explicit0"], np.concatenate(features, axis=1)))))
    both = layer_norm(w["norm"], np.concatenate([x, explicit], axis=1))
    return sigmoid(linear(w["out"], gelu(linear(w["out0"], both))))


@dataclass(frozen=True)
class ModelConfig:
    """Lengths of a model's inputs and layers; of a 5-wide output the result is the include score."""

    query_dim: int = 32
    summary_dim: int = 32
    edge_dim: int = 16
    full_dim: int = 64
    path_dim: int = 32
    scalar_dim: int = 2
    model_kind: str = "mlp"
    hidden_dim: int = 128
    attach_hidden_dim: int = 96
    transformer_layers: int = 2
    transformer_heads: int = 4
    attach_head_kind: str = "transformer"
    traversal_output_dim: int = 6

    def __post_init__(self) -> None:
        if self.model_kind not in ("mlp", "transformer"):
            raise ValueError(f"unknown model_kind {self.model_kind!r}")
        if self.attach_head_kind not in ("transformer", "hybrid"):
            raise ValueError(f"unknown attach_head_kind {self.attach_head_kind!r}")
        if self.traversal_output_dim not in (5, 6):
            raise ValueError("traversal_output_dim must be 5 or 6")

    @classmethod
    def from_manifest(cls, manifest: dict, **given) -> ModelConfig:
        """The lengths a manifest states under ``dims``; what it does not state keeps its default."""
        dims = manifest.get("dims", {})
        return cls(**({f"{k}_dim": int(dims[k]) for k in ("query", "summary", "edge", "full", "path") if k in dims} | given))

    def edge_widths(self) -> list[int]:
        s, e = self.summary_dim, self.edge_dim
        return [self.query_dim, s, e, s, self.path_dim, self.scalar_dim, *[s] * 6, *[e] * 2]

    def attach_widths(self) -> list[int]:
        s, f = self.summary_dim, self.full_dim
        return [s, s, f, f, self.path_dim, s, s, f, f, s, s]


def split_inputs(features: Column | str, widths: list[int], names: list[str]) -> list[Column]:
    """One feature array cut into its parts, in order."""
    starts = np.cumsum([1, *widths])
    return [F.slice(col(features), int(s), int(w)).alias(n) for s, w, n in zip(starts, widths, names)]


def _flat(w: dict, prefix: str = "") -> dict[str, np.ndarray]:
    return {k: v for name, part in w.items() for k, v in (_flat(part, f"{prefix}{name}.") if isinstance(part, dict) else {prefix + name: part}).items()}


def _nested(flat: dict[str, np.ndarray]) -> dict:
    out: dict = {}
    for name, v in flat.items():
        *way, last = name.split(".")
        at = out
        for step in way:
            at = at.setdefault(step, {})
        at[last] = v
    return out


def _perceptron_weights(rng: np.random.Generator, widths: list[int], hidden: int, outputs: int) -> dict:
    return {"l0": _layer(rng, hidden, sum(widths)), "l1": _layer(rng, hidden, hidden), "l2": _layer(rng, outputs, hidden)}


def _encoder_weights(rng: np.random.Generator, projections: dict[str, int], tokens: int, hidden: int, layers: int, outputs: int) -> dict:
    def ones(n: int = hidden) -> dict:
        return {"w": np.ones(n), "b": np.zeros(n)}

    w: dict = {n: _layer(rng, hidden, k) for n, k in projections.items()}
    w |= {"cls": np.zeros(hidden), "types": rng.standard_normal((tokens + 1, hidden)), "norm": ones(), "out": _layer(rng, outputs, hidden)}
    w["layers"] = {
        str(i): {n: _layer(rng, hidden, hidden) for n in ("q", "k", "v", "o")} | {"f1": _layer(rng, 4 * hidden, hidden), "f2": _layer(rng, hidden, 4 * hidden), "n1": ones(), "n2": ones()} for i in range(layers)
    }
    return w


@dataclass(frozen=True)
class NeuralScorer:
    """A pair of models, one for edges and one for attaching, over whole Arrow batches.

    A row that lacks a vector, its confidence or its hop has null scores; a missing full
    vector is replaced by the summary when attaching. Vectors are brought to the model's lengths.
    """

    config: ModelConfig
    weights: dict

    @classmethod
    def seeded(cls, config: ModelConfig | None = None, seed: int = 3) -> NeuralScorer:
        """Untrained weights, the same for a seed everywhere."""
        c, rng = config or ModelConfig(), np.random.default_rng(seed)
        if c.model_kind == "mlp":
            return cls(c, {"edge": _perceptron_weights(rng, c.edge_widths(), c.hidden_dim, c.traversal_output_dim), "attach": _perceptron_weights(rng, c.attach_widths(), c.attach_hidden_dim, 1)})
        edge = _encoder_weights(rng, {"query": c.query_dim, "summary": c.summary_dim, "edge": c.edge_dim, "path": c.path_dim, "scalar": c.scalar_dim}, len(EDGE_TOKENS), c.hidden_dim, c.transformer_layers, c.traversal_output_dim)
        h = c.attach_hidden_dim
        attach = _encoder_weights(rng, {"summary": c.summary_dim, "full": c.full_dim, "path": c.path_dim}, len(ATTACH_TOKENS), h, c.transformer_layers, 1)
        if c.attach_head_kind == "hybrid":
            attach |= {"explicit0": _layer(rng, h, sum(c.attach_widths())), "explicit1": _layer(rng, h, h), "norm": {"w": np.ones(2 * h), "b": np.zeros(2 * h)}, "out0": _layer(rng, h, 2 * h), "out": _layer(rng, 1, h)}
        return cls(c, {"edge": edge, "attach": attach})

    def save(self, path: str) -> None:
        """One npz: the config as JSON and every array by its dotted name."""
        np.savez(path, config=np.array(json.dumps(asdict(self.config))), **_flat(self.weights))

    @classmethod
    def load(cls, path: str) -> NeuralScorer:
        """What ``save`` wrote; a config without an output width takes that of the weights."""
        with np.load(path) as z:
            given = json.loads(str(z["config"]))
            weights = _nested({k: z[k] for k in z.files if k != "config"})
        last = weights["edge"]["l2" if given.get("model_kind", "mlp") == "mlp" else "out"]
        return cls(ModelConfig(**({"traversal_output_dim": len(last["b"])} | given)), weights)

    def _sent(self, df: DataFrame, part: str):
        return df.sparkSession.sparkContext.broadcast(self.weights[part])

    def edge_columns(self, df: DataFrame) -> DataFrame:
        c, sent = self.config, self._sent(df, "edge")

        def score(query, current, edge, dst, path, conf, hop) -> dict[str, np.ndarray]:
            given = [resize(r, n) for r, n in zip((query, current, edge, dst, path), c.edge_widths())]
            scalars = np.clip(np.stack([conf, hop / 3.0], axis=1), 0.0, 1.0)
            scalars = np.pad(scalars, ((0, 0), (0, max(0, c.scalar_dim - 2))))[:, : c.scalar_dim]
            there = np.logical_and.reduce([r.there for r in given]) & ~np.isnan(conf) & ~np.isnan(hop)
            features = edge_parts([*[r.x for r in given], np.nan_to_num(scalars)])
            out = perceptron(sent.value, features) if c.model_kind == "mlp" else transformer_edge(sent.value, features, c.transformer_heads)
            out = np.where(there[:, None], out, np.nan)
            return dict(zip(SCORES, [*out.T, out[:, 2]] if out.shape[1] == 5 else out.T))

        return with_scores(df, ["query", "cur_eff", "edge_vector", "dst_eff", "path"], ["confidence", "hop"], SCORES, in_blocks(score))

    def attach_column(self, df: DataFrame) -> DataFrame:
        c, sent = self.config, self._sent(df, "attach")

        def score(new, cand, new_full, cand_full, new_summary, cand_summary, path) -> dict[str, np.ndarray]:
            full = [_else(resize(f, c.full_dim), resize(s, c.full_dim)) for f, s in ((new_full, new_summary), (cand_full, cand_summary))]
            given = [resize(new, c.summary_dim), resize(cand, c.summary_dim), *full, resize(path, c.path_dim)]
            there = np.logical_and.reduce([r.there for r in given])
            features = attach_parts([r.x for r in given])
            out = perceptron(sent.value, features) if c.model_kind == "mlp" else transformer_attach(sent.value, features, c.transformer_heads)
            return {"attach": np.where(there, out[:, 0], np.nan)}

        return with_scores(df, ["new_eff", "cand_eff", "new_full", "cand_full", "new_summary", "cand_summary", "path"], [], ["attach"], in_blocks(score))


def _else(a: Rows, b: Rows) -> Rows:
    """a, and b where a is missing."""
    return Rows(np.where(a.there[:, None], a.x, b.x), a.size, a.there | b.there)

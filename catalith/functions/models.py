"""Encoders and pair models as injectable batch functions; each is loaded once a Python worker."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HashingEncoder:
    """A text encoder without weights: signed hashed words, scaled to length one.  For tests and as a fallback."""

    dim: int = 64
    name: str = "hashing"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    def encode_sparse(self, texts: list[str]) -> list[dict[int, float]]:
        """Weights of a text's words by 32-bit hash."""
        out = []
        for t in texts:
            weights: dict[int, float] = {}
            for w in t.lower().split():
                k = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big")
                weights[k] = weights.get(k, 0.0) + 1.0
            out.append(weights)
        return out


@dataclass(frozen=True)
class HashingImageEncoder:
    """An image encoder without weights: how often each byte, by its place in the file, occurs.  For tests."""

    dim: int = 64
    name: str = "hashing"

    def encode(self, images: list[bytes]) -> list[list[float]]:
        out = []
        for data in images:
            at = np.frombuffer(data, np.uint8)
            v = np.bincount((at.astype(np.int64) + 31 * (np.arange(len(at)) % 7)) % self.dim, minlength=self.dim).astype(float)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


@dataclass(frozen=True)
class OverlapPairs:
    """A pair model without weights: the share of the query's words that the text has."""

    name: str = "overlap"

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return overlap_pairs(pairs)


def _needs(module: str):  # noqa: ANN202
    """A library that brings weights, or a plain message that it is not there."""
    try:
        return import_module(module)
    except ImportError as e:
        raise RuntimeError(f"this provider needs the library {module}") from e


@lru_cache(maxsize=8)
def _loaded(module: str, kind: str, *options: str) -> object:
    """A model, loaded once a worker."""
    return getattr(_needs(module), kind)(*options)


@dataclass(frozen=True)
class SentenceEncoder:
    """Texts by a sentence transformer."""

    model: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]:
        return _loaded("sentence_transformers", "SentenceTransformer", self.model).encode(texts, normalize_embeddings=True).tolist()


@dataclass(frozen=True)
class PooledEncoder:
    """Texts by a plain transformer, the mean of its token vectors."""

    model: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]:
        transformers = _needs("transformers")
        tokens = transformers.AutoTokenizer.from_pretrained(self.model)(texts, padding=True, truncation=True, return_tensors="pt")
        states = transformers.AutoModel.from_pretrained(self.model)(**tokens).last_hidden_state.detach().numpy()
        return mean_pool(states, tokens["attention_mask"].numpy()).tolist()


@dataclass(frozen=True)
class DenseSparseEncoder:
    """Texts by a model that gives dense vectors and weights of tokens in one pass."""

    model: str
    dim: int

    def _run(self, texts: list[str]) -> dict:
        return _loaded("FlagEmbedding", "BGEM3FlagModel", self.model).encode(texts, return_dense=True, return_sparse=True)

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self._run(texts)["dense_vecs"].tolist()

    def encode_sparse(self, texts: list[str]) -> list[dict[int, float]]:
        return [{int(k): float(v) for k, v in w.items()} for w in self._run(texts)["lexical_weights"]]


@dataclass(frozen=True)
class OnnxEncoder:
    """Texts by a quantised model that runs without a deep-learning framework."""

    model: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [v.tolist() for v in _loaded("fastembed", "TextEmbedding", self.model).embed(texts)]


@dataclass(frozen=True)
class ClipEncoder:
    """Images by a model trained on images and their captions."""

    model: str
    weights: str
    dim: int

    def encode(self, images: list[bytes]) -> list[list[float]]:
        clip, torch, pillow = _needs("open_clip"), _needs("torch"), _needs("PIL.Image")
        model, _, prepare = clip.create_model_and_transforms(self.model, pretrained=self.weights)
        with torch.no_grad():
            v = model.encode_image(torch.stack([prepare(pillow.open(io.BytesIO(x))) for x in images])).numpy()
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@dataclass(frozen=True)
class CrossEncoderPairs:
    """Pairs by a cross encoder."""

    model: str

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [float(s) for s in _loaded("sentence_transformers", "CrossEncoder", self.model).predict(pairs)]


ENCODERS: dict[str, Callable[..., object]] = {"hashing": HashingEncoder, "sentence": SentenceEncoder, "pooled": PooledEncoder, "dense_sparse": DenseSparseEncoder, "onnx": OnnxEncoder}
IMAGE_ENCODERS: dict[str, Callable[..., object]] = {"hashing": HashingImageEncoder, "clip": ClipEncoder}
PAIR_MODELS: dict[str, Callable[..., object]] = {"overlap": OverlapPairs, "cross_encoder": CrossEncoderPairs}


def _made(known: dict[str, Callable[..., object]], provider: str, options: dict) -> object:
    if provider not in known:
        raise ValueError(f"unknown provider {provider}; known are {', '.join(known)}")
    return known[provider](**options)


def create_encoder(provider: str, **options: object) -> object:
    return _made(ENCODERS, provider, options)


def create_image_encoder(provider: str, **options: object) -> object:
    return _made(IMAGE_ENCODERS, provider, options)


def create_pair_model(provider: str, **options: object) -> object:
    return _made(PAIR_MODELS, provider, options)


def encode_images(df: DataFrame, images_col: str, out_col: str, encoder: Callable[[], object]) -> DataFrame:
    """Rows with one vector for each readable image (binary) of a list; those that cannot be read are left out."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out_col} array<array<double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()

        def vectors(images: list[bytes] | None) -> list[list[float]]:
            out = []
            for data in images if images is not None else ():
                try:
                    out += model.encode([bytes(data)]) if data else []
                except Exception:  # noqa: S112 - an image that cannot be read
                    continue
            return out

        for b in batches:
            yield b.assign(**{out_col: [vectors(x) for x in b[images_col]]})

    return df.mapInPandas(run, schema)


def encode_column(df: DataFrame, text_col: str, out_col: str, encoder: Callable[[], HashingEncoder], dim: int, sparse_col: str | None = None) -> DataFrame:
    """Rows with the vector of a text; a blank text has the zero vector, a failed one null, and equal texts are encoded once a batch."""
    added = f"{out_col} array<double>" + (f", {sparse_col} map<bigint,double>" if sparse_col else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + added

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for b in batches:
            wanted = sorted({t for t in b[text_col] if t is not None and t.strip()})
            try:
                vectors = dict(zip(wanted, model.encode(wanted)))
            except Exception:
                vectors = {}
            zero = [0.0] * dim
            new = {out_col: [vectors.get(t) if t is not None and t.strip() else zero for t in b[text_col]]}
            if sparse_col:
                sparse = dict(zip(wanted, model.encode_sparse(wanted)))
                new[sparse_col] = [sparse.get(t) for t in b[text_col]]
            yield b.assign(**new)

    return df.mapInPandas(run, schema)


def encode_missing(df: DataFrame, cache: DataFrame, text_col: str, encoder: Callable[[], HashingEncoder], dim: int) -> DataFrame:
    """(hash, vector) of the texts the cache lacks, each once; the cache is a table keyed by the text's hash."""
    texts = df.select(F.sha2(text_col, 256).alias("hash"), F.col(text_col).alias("text")).filter(F.length(F.trim("text")) > 0).dropDuplicates(["hash"])
    return encode_column(texts.join(cache.select("hash"), "hash", "left_anti"), "text", "vector", encoder, dim).select("hash", "vector")


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the unmasked token vectors, scaled to length one."""
    m = mask[..., None].astype(float)
    v = (tokens * m).sum(axis=1) / np.clip(m.sum(axis=1), 1e-9, None)
    return v / np.clip(np.linalg.norm(v, axis=1, keepdims=True), 1e-12, None)


def overlap_pairs(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of each query's words that its text has."""
    out = []
    for query, text in pairs:
        words = set(query.lower().split())
        out.append(len(words & set(text.lower().split())) / len(words) if words else 0.0)
    return out

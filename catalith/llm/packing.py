"""Documents put into containers of fixed capacity by vector best-fit.

Sizes are tokens of a public tokenizer.  A container has three capacities: tokens, documents and attention cost (the
sum of the squared sizes of its parts).  Each kind of container states them; where it only states tokens, it holds a
document for each ``TOKENS_A_DOCUMENT`` tokens and ``ATTENTION_SHARE`` of the squared tokens, which few large parts
reach before the tokens do.  A part that alone exceeds the attention capacity must stand somewhere, since only tokens
split a document: its container is filled by tokens and documents alone.
Documents are taken by falling size; each goes to the open container that is
best under every constraint: by ``residual`` the one whose remaining capacities after taking it have the least weighted
norm, by ``dot`` the one whose remaining capacities point most in the document's direction.  Open containers are kept
by remaining tokens, and the search for the least norm stops where the tokens alone already exceed the best: the choice
is that of a full search.

The corpus is cut into blocks of about ``BLOCK`` documents by a hash of the id, each packed on its own: the waste is
that of at most one poorly filled container or so a block and kind.  A document is split only if it alone exceeds the
capacity, into full parts and a rest; the rest is packed like any document.

Cases: null and empty texts have no tokens and give no row; a document of exactly the capacity fills a container;
equal sizes go by id; equal containers by the order they were opened; repeated rows are packed each; an empty table
gives an empty assignment.
"""

from __future__ import annotations

import base64
import math
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.runtime import cut, require

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How byte-level BPE cuts text before merging; fixed value.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 20_000
TOKENS_A_DOCUMENT = 32
ATTENTION_SHARE = 0.6  # of the squared token capacity
WEIGHTS = (1.0, 0.05, 0.05)  # tokens, documents, attention cost
ASSIGNMENT = "kind string, container_id bigint, slot int, doc_id bigint, part int, start_token bigint, n_tokens int"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of all documents with tokens.  The vocabulary file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(SparkFiles.get(os.path.basename(path)))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["id"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in b["text"]]})

    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return texts.mapInPandas(count, "doc_id bigint, n_tokens bigint").filter("n_tokens > 0")


class Packer:
    """The open containers of one block."""

    def __init__(self, capacity: int, documents: int, attention: float, weights: tuple[float, float, float] = WEIGHTS, rule: str = "residual"):
        self.full = (capacity, documents, attention)
        self.weights, self.rule = weights, rule
        self.levels: list[int] = []  # remaining token counts of the open containers, in order
        self.open: dict[int, list[int]] = {}  # containers by remaining tokens
        self.left: list[tuple[int, int, float]] = []

    def norm(self, left: tuple[int, int, float], n: int) -> float:
        rest = (left[0] - n, left[1] - 1, 0.0 if left[2] == math.inf else left[2] - n * n)
        return sum(w * (r / f) ** 2 for w, r, f in zip(self.weights, rest, self.full))

    def dot(self, left: tuple[int, int, float], n: int) -> float:
        rest = (left[0], left[1], 0.0 if left[2] == math.inf else left[2])
        return -sum(w * (x / f) * (r / f) for w, x, r, f in zip(self.weights, (n, 1, n * n), rest, self.full))

    def choose(self, n: int) -> int:
        best, chosen = math.inf, -1
        for level in self.levels[bisect_left(self.levels, n) :]:
            if self.rule == "residual" and self.weights[0] * ((level - n) / self.full[0]) ** 2 > best:
                break  # no container with more tokens left can be better
            seen = set()
            for c in self.open[level]:
                left = self.left[c]
                if left[1:] in seen or left[1] < 1 or left[2] < n * n:
                    continue
                seen.add(left[1:])  # containers that are alike: the first opened
                score = self.norm(left, n) if self.rule == "residual" else self.dot(left, n)
                if score < best:
                    best, chosen = score, c
        return chosen

    def put(self, n: int) -> int:
        """The container an item of n tokens goes to."""
        if n > self.full[0]:
            raise ValueError("an item exceeds the container")
        c = self.choose(n)
        if c < 0:
            c = len(self.left)
            self.left.append(self.full if n * n <= self.full[2] else (*self.full[:2], math.inf))  # too large by itself: no bound
        else:
            level = self.left[c][0]
            self.open[level].remove(c)
            if not self.open[level]:
                del self.open[level]
                self.levels.pop(bisect_left(self.levels, level))
        tokens, documents, attention = self.left[c]
        self.left[c] = (tokens - n, documents - 1, attention - n * n)
        if tokens - n > 0 and documents > 1:
            if tokens - n not in self.open:
                self.open[tokens - n] = []
                insort(self.levels, tokens - n)
            insort(self.open[tokens - n], c)
        return c


def capacities(tokens: int, documents: int | None = None, attention: float | None = None) -> tuple[int, int, float]:
    """The capacities of a kind of container, with the defaults for those it does not state."""
    return tokens, max(1, documents or math.ceil(tokens / TOKENS_A_DOCUMENT)), float(attention or ATTENTION_SHARE * tokens * tokens)


def pack_block(kind: str, full_capacity: tuple[int, int, float], block: int, ids: list[int], sizes: list[int], rule: str = "residual") -> pd.DataFrame:
    """The assignment of one block's documents."""
    items, rows = [], []
    capacity, full = full_capacity[0], 0
    for i, n in zip(ids, sizes):
        parts = (n - 1) // capacity
        for p in range(parts):  # full parts of a document larger than any container
            rows.append((full, i, p, p * capacity, capacity))
            full += 1
        items.append((n - parts * capacity, i, parts, parts * capacity))
    packer = Packer(*full_capacity, rule=rule)
    for n, i, part, start in sorted(items, key=lambda x: (-x[0], x[1])):
        rows.append((full + packer.put(n), i, part, start, n))
    out = pd.DataFrame(rows, columns=["container_id", "doc_id", "part", "start_token", "n_tokens"])
    out["slot"] = out.groupby("container_id").cumcount()
    out["container_id"] += block << 32
    return out.assign(kind=kind)[["kind", "container_id", "slot", "doc_id", "part", "start_token", "n_tokens"]]


def pack(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER, rule: str = "residual") -> DataFrame:
    """(kind, container_id, slot, doc_id, part, start_token, n_tokens) for every kind of container.

    ``containers``: (kind, capacity_tokens) and, if stated, capacity_documents and capacity_attention; a handful of rows.
    """
    require(documents, "doc_id", "text")
    require(containers, "kind", "capacity_tokens")
    kinds = _kinds(containers)
    sizes = cut(token_counts(documents, path=path))
    blocks = max(1, math.ceil(sizes.count() / BLOCK))
    if not kinds:
        return documents.sparkSession.createDataFrame([], ASSIGNMENT)
    spread = sizes.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.lit(list(kinds))).alias("kind"))

    def fill(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pack_block(key[0], kinds[key[0]], int(key[1]), b["doc_id"].tolist(), b["n_tokens"].tolist(), rule)

    return spread.groupBy("kind", "block").applyInPandas(fill, ASSIGNMENT)


def _kinds(containers: DataFrame) -> dict[str, tuple[int, int, float]]:
    stated = [F.col(c) if c in containers.columns else F.lit(None).alias(c) for c in ("capacity_documents", "capacity_attention")]
    rows = containers.select("kind", "capacity_tokens", *stated).filter("kind is not null and capacity_tokens > 0").collect()
    return {r[0]: capacities(int(r[1]), *r[2:]) for r in rows}


def fill_report(assignment: DataFrame, containers: DataFrame) -> DataFrame:
    """(kind, containers, tokens, fill, documents_fill, attention_fill): how full the containers are in each capacity."""
    size = F.col("n_tokens").cast("double")
    each = assignment.groupBy("kind", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.sum(size * size).alias("attention"))
    used = each.groupBy("kind").agg(F.count("*").alias("containers"), *[F.sum(c).alias(c) for c in ("tokens", "documents", "attention")])
    full = assignment.sparkSession.createDataFrame([(k, *c) for k, c in _kinds(containers).items()], "kind string, c_tokens bigint, c_documents bigint, c_attention double")
    share = lambda c: F.round(F.col(c) / (F.col("containers") * F.col("c_" + c)), 4)
    return used.join(full, "kind").select("kind", "containers", "tokens", share("tokens").alias("fill"), share("documents").alias("documents_fill"), share("attention").alias("attention_fill"))

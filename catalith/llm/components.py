"""Connected components over (g, id, key) links, with every step in the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.runtime import cut

CHUNK = 50_000  # links joined up in one go, about


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one partition: each id with the least id it is joined to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    first: dict[str, int] = {}
    for b in batches:
        for i, k in zip(b["id"].tolist(), b["key"].tolist()):
            a, c = root(i), root(first.setdefault(k, i))
            if a != c:
                parent[max(a, c)] = min(a, c)
    ids = list(parent)
    yield pd.DataFrame({"id": ids, "root": [root(i) for i in ids]})


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): ids that share a key, directly or through others, get the least id of all of them.

    Links of one group g are joined up together, in chunks by key where the group is large, so one pass settles all
    groups but the large ones.  What several chunks left apart is settled by least labels: a key is aggregated before
    it is joined back, so one shared by a third of all ids costs a row there, and labels jump to the label of their
    label, so a chain of n takes about log n rounds.
    """
    links = cut(links.select("g", "id", "key").distinct())
    chunks = links.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = links.join(chunks, "g").select("id", "key", "g", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk")).repartition("g", "chunk")
    roots = placed.select("id", "key").mapInPandas(_joined, "id bigint, root bigint").groupBy("id").agg(F.min("root").alias("root"))
    labels = cut(ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("label")))
    while True:
        least = links.join(labels, "id").groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
        if least.isEmpty():
            return labels
        offered = links.join(least, "key").groupBy("id").agg(F.min("least").alias("least"))
        lower = labels.join(offered, "id", "left").select("id", F.least("label", F.coalesce("least", "label")).alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = cut(lower.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")))

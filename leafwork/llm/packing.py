"""Texts packed into containers of fixed capacity (problem 7): conflict-constrained best fit.

Sizes are numbers of tokens. A text beyond the capacity is split: full parts fill containers of their own, the rest is an
item like others. Items are spread by hash over shards of about ``shard_items`` items, so that no task grows with the
data; each shard is packed on its own, in decreasing size. Bins are ordered by residual room in a bit set of residuals;
each carries a bitmap of its sources and one of its duplicate clusters. The search starts at the smallest residual that
holds the item and goes on to the next until a compatible bin is found; where there is none, a bin is opened. Texts of one
source, and copies of a text, never share a container. Only a source with more items than the shard's items fill
containers (tokens over capacity, rounded up) must share some: it is dealt into as many classes as the pigeonhole asks for,
each a bit of its own, so that no container holds more of its texts than that least number.

Defined cases: null and empty texts have no tokens, are kept with part_no 0 and are in no container (null); a null source
conflicts with nothing; ties go to the smaller doc_id and the older bin; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.tokens import count_tokens
from leafwork.session import cut

#: Items of a shard; a shard is packed by one task.
SHARD_ITEMS = 20_000
#: Weights of a source's number of items against an item's size in the order of packing, tried in turn, and the part of bins
#: above the fewest possible that ends the trial.
FREQUENT = (0.0, 16.0)
SLACK = 0.005


class Bins:
    """Open bins of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r is set where a bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def find(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Residual and place of the tightest bin of at least ``size`` residual without the given bits."""
        left = self.some >> size
        base = size
        sources, clusters = self.sources, self.clusters
        while left:
            step = (left & -left).bit_length()
            residual = base + step - 1
            for place, b in enumerate(self.at[residual]):
                if not (sources[b] & source or clusters[b] & cluster):
                    return residual, place
            left >>= step
            base += step
        return None

    def put(self, size: int, source: int, cluster: int) -> int:
        spot = self.find(size, source, cluster)
        if spot is None:
            b, residual = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        else:
            residual, place = spot
            b = self.at[residual].pop(place)
            if not self.at[residual]:
                self.some &= ~(1 << residual)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = residual - size
        if left:  # full bins are closed
            insort(self.at[left], b)
            self.some |= 1 << left
        return b


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each item; the items come in decreasing size."""
    bins = Bins(capacity)
    return [bins.put(*x) for x in zip(sizes, sources, clusters)]


PACKED = "pack_id int, doc_id bigint, part_no int, n_tokens int, container string"


def source_bits(sources: list[str | None], containers: int) -> list[int]:
    """A bit of each item's source; a source of more than ``containers`` items has several, dealt in turn."""
    codes, uniques = pd.factorize(pd.Series(sources, dtype=object))
    classes = -(-np.bincount(codes[codes >= 0], minlength=len(uniques)) // max(1, containers))
    first = np.concatenate([[0], np.cumsum(classes)])
    seen = [0] * len(uniques)
    out = []
    for c in codes.tolist():
        if c < 0:
            out.append(0)
            continue
        out.append(1 << int(first[c] + seen[c] % classes[c]))
        seen[c] += 1
    return out


def cluster_bits(clusters: list[int]) -> list[int]:
    """A bit for each cluster of several items; others can't conflict."""
    s = pd.Series(clusters)
    codes, _ = pd.factorize(s.where(s.duplicated(keep=False)))
    return [1 << int(c) if c >= 0 else 0 for c in codes]


def pack_shard(pdf: pd.DataFrame, capacity: int) -> list[int]:
    """Bin of each item of a shard (size, doc_id, part_no, source, cluster). Items come in decreasing size; where conflicts
    leave more than SLACK of bins above the fewest possible, also with the items of frequent sources first, which have the
    fewest bins to go to, and the packing of fewer bins is kept."""
    least = -(-int(pdf["size"].sum()) // capacity)
    pdf = pdf.sort_values(["size", "doc_id", "part_no"], ascending=[False, True, True], kind="stable")
    often = pdf.source.map(pdf.source.value_counts()).fillna(0).astype(float)
    best = None
    for weight in FREQUENT:
        at = (-(pdf["size"] / capacity + weight * often / least)).sort_values(kind="stable").index
        own = pdf.loc[at]
        bins = pd.Series(pack(own["size"].tolist(), source_bits(own.source.tolist(), least), cluster_bits(own.cluster.tolist()), capacity), index=at)
        if best is None or bins.max() < best.max():
            best = bins
        if best.max() + 1 <= (1 + SLACK) * least:
            break
    return best.reindex(pdf.index).sort_index().tolist()


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.reset_index(drop=True)
    head = f"{int(pdf.pack_id.iloc[0])}-{int(pdf.shard.iloc[0])}-"
    bins = pack_shard(pdf, int(pdf.capacity.iloc[0]))
    return pd.DataFrame({"pack_id": pdf.pack_id, "doc_id": pdf.doc_id, "part_no": pdf.part_no, "n_tokens": pdf["size"], "container": [f"{head}{b}" for b in bins]})


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, shard_items: int = SHARD_ITEMS, folder: str | None = None) -> DataFrame:
    """pack_id, doc_id, part_no, n_tokens, container: every part of every document for every row of ``pack_sizes``."""
    packs = pack_sizes.filter("capacity > 0").select("pack_id", "tokenizer", "capacity")
    # a fixed table of settings: one pass over the texts for each tokenizer named
    names = [r[0] for r in packs.select("tokenizer").distinct().orderBy("tokenizer").collect()]
    sized = None
    for name in names:
        one = count_tokens(documents, name, folder).withColumn("tokenizer", F.lit(name))
        sized = one if sized is None else sized.unionByName(one)
    if sized is None:
        return documents.sparkSession.createDataFrame([], PACKED)
    sized = cut(sized)
    shards = max(1, -(-sized.count() // max(1, len(names)) // shard_items))
    items = sized.join(F.broadcast(packs), "tokenizer").withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")).withColumn("rest", (F.col("n_tokens") % F.col("capacity")).cast("int"))
    whole = items.filter("full > 0").select("pack_id", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no"), F.col("capacity").cast("int").alias("n_tokens"))
    whole = whole.withColumn("container", F.concat_ws("-", "pack_id", F.lit("doc"), "doc_id", "part_no"))
    none = items.filter("n_tokens = 0").select("pack_id", "doc_id", F.lit(0).alias("part_no"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"))
    rest = items.filter("rest > 0").select("pack_id", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", F.col("full").alias("part_no"), F.col("rest").alias("size"), "source", "cluster")
    packed = rest.groupBy("pack_id", "shard").applyInPandas(_pack_group, PACKED)
    return packed.unionByName(whole).unionByName(none)


def room_left(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """pack_id, containers, tokens and the unused share of the room of all containers."""
    bins = packed.filter("container IS NOT NULL").groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("used"))
    return bins.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).join(F.broadcast(pack_sizes.select("pack_id", "capacity")), "pack_id").select("pack_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))

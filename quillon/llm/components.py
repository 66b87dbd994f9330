"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up[x]
        return r

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the links of each batch by stars that connect the same members."""
    for b in batches:
        f = Forest()
        for s, d in zip(b["src"].tolist(), b["dst"].tolist()):
            f.link(s, d)
        if e := f.edges():
            yield pd.DataFrame(e, columns=["src", "dst"])


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(src, dst) links of longs -> (id, component): each linked id with the smallest id reachable from it.

    Self links and repeated links are allowed; ids without a link to another id do not appear. Each
    round is two joins on per-node minima, which pre-aggregate before the shuffle and are written first, so that
    both sides of a join are plain shuffles: Spark splits the links of a node that has very many of them. Rounds
    grow with the logarithm of the longest chain. Every round is checkpointed. Raises if most_rounds do
    not suffice.
    """
    e = links.where("src is not null and dst is not null and src <> dst").mapInPandas(_contract, "src long, dst long").distinct()
    e, before = durable(e), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = durable(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m")))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = durable(large)
        least = durable(large.groupBy("src").agg(F.min("dst").alias("m")))
        small = large.join(least, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("x")).select("x.*").where("src <> dst").distinct()
        e = durable(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("id"), F.col("dst").alias("component"))).distinct()

"""A versioned multigraph on DataFrames, with three physical layouts that give equal answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import Scratch
from skein.sinks import csr_offsets

# The representation names of the command line and the layout each one gets.
STRATEGIES = {"adj": "append", "morph": "append", "csr": "rebuild", "lccsr": "rebuild", "lscsr": "delta"}


class GraphStore:
    """Directed multigraph over the ids 0..size()-1, grown by batches.

    append: every batch stays a table of its own. rebuild: each commit rewrites the edges
    clustered by source. delta: batches pile up in a log, which a commit folds into the base
    once it holds more than `threshold` times the base's rows.
    """

    def __init__(self, spark: SparkSession, strategy: str = "append", threshold: float = 0.3):
        strategy = STRATEGIES.get(strategy, strategy)
        if strategy not in ("append", "rebuild", "delta"):
            raise ValueError(f"unknown graph representation: {strategy}")
        self.spark, self.strategy, self.threshold = spark, strategy, threshold
        self._scratch = Scratch(spark)
        self._base: DataFrame | None = None
        self._deltas: list[DataFrame] = []
        self._base_rows = self._delta_rows = 0
        self._size = 0
        self.log: list[dict] = []

    # -- mutation ---------------------------------------------------------------------

    def ingest(self, batch: DataFrame) -> "GraphStore":
        """Append a batch, as (src, dst) or (src, dsts); duplicates and self loops stay."""
        if "dsts" in batch.columns:
            batch = batch.select("src", F.explode("dsts").alias("dst"))
        rows = self._scratch.cut(batch.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull()))
        top = rows.agg(F.max(F.greatest("src", "dst")).alias("m"), F.count(F.lit(1)).alias("n")).first()
        if top["n"]:
            self._size = max(self._size, top["m"] + 1)
            self._deltas.append(rows)
            self._delta_rows += top["n"]
        return self

    def post_ingest(self) -> bool:
        """Reorganise as the layout asks; True if the base was rewritten."""
        base, delta = self._base_rows, self._delta_rows
        rewrite = bool(delta) and (self.strategy == "rebuild" or self.strategy == "delta" and delta > self.threshold * base)
        if rewrite:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            old = [x for x in [self._base, *self._deltas] if x is not None]
            merged = self.edges().repartition(n, "src").sortWithinPartitions("src", "dst")
            self._base = self._scratch.cut(merged)
            self._scratch.drop(*old)
            self._base_rows, self._delta_rows, self._deltas = base + delta, 0, []
        self.log.append({"batch": len(self.log), "base_rows": base, "delta_rows": delta, "compacted": rewrite})
        return rewrite

    def commit(self, batch: DataFrame | None = None) -> "GraphStore":
        if batch is not None:
            self.ingest(batch)
        self.post_ingest()
        return self

    # -- access -----------------------------------------------------------------------

    def size(self) -> int:
        """Largest id seen plus one: ids without edges below it count as vertices."""
        return self._size

    def edge_count(self) -> int:
        return self._base_rows + self._delta_rows

    def edges(self) -> DataFrame:
        parts = [x for x in [self._base, *self._deltas] if x is not None]
        if not parts:
            return self.spark.createDataFrame([], "src long, dst long")
        return reduce(DataFrame.unionByName, parts)

    def vertices(self) -> DataFrame:
        return self.spark.range(self._size).select(F.col("id").alias("vertex"))

    def out_degree(self, zero_filled: bool = True) -> DataFrame:
        d = self.edges().groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
        if not zero_filled:
            return d
        return self.vertices().join(d, "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def neighbors(self, sources: DataFrame) -> DataFrame:
        """(src, dst) of all edges that leave the given `vertex` rows."""
        return self.edges().join(sources.select(F.col("vertex").alias("src")), "src", "left_semi")

    def sorted_edges(self) -> DataFrame:
        """(src, dsts): adjacency sorted by destination."""
        return self.edges().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))

    def find_edges(self, pairs: DataFrame) -> DataFrame:
        """The (src, dst) pairs that exist as edges."""
        return pairs.join(self.edges(), ["src", "dst"], "left_semi")

    def csr(self) -> DataFrame:
        return csr_offsets(self.edges(), self._size)

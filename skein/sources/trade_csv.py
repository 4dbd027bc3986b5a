"""The five typed CSV files of the trade network, as one property graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The id offset that keeps devices apart from persons, (2^64 - 1) / 2.
DEVICE_OFFSET = 9223372036854775807

_FLOW = ["epoch_time", "duration", "protocol", "src_port", "dst_port", "src_packets", "dst_packets", "src_bytes", "dst_bytes"]
EDGE_COLUMNS = ["type", "src_type", "src", "dst_type", "dst", "topic", "date", "amount", "weight", *_FLOW]


def uid(node_type: Column, node_id: Column) -> Column:
    """One unsigned id space: devices are shifted beyond the signed range."""
    wide = node_id.cast("decimal(20,0)")
    device = (F.pmod(node_id, F.lit(DEVICE_OFFSET)) + F.lit(DEVICE_OFFSET).cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(node_type == "DEVICE", device).otherwise(wide)


def _csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.csv(path, comment="#", schema=schema, mode="PERMISSIVE")


def _edge(df: DataFrame, type_: str, src_type: str, dst_type: str, **cols: Column) -> DataFrame:
    have = {
        "type": F.lit(type_), "src_type": F.lit(src_type), "dst_type": F.lit(dst_type), "topic": F.lit(0).cast("long"),
        "date": F.lit(None).cast("date"), "amount": F.lit(0.0), "weight": F.lit(0.0), **{c: F.lit(None).cast("long") for c in _FLOW}, **cols,
    }
    return df.select(*[have[c].alias(c) for c in EDGE_COLUMNS])


def sale_pairs(sales: DataFrame) -> DataFrame:
    """Each sale (src, dst, ...) as two edges: SALE src->dst and PURCHASE dst->src."""
    rest = [c for c in sales.columns if c not in ("src", "dst", "type")]
    sides = F.explode(
        F.array(
            F.struct(F.lit("SALE").alias("type"), F.col("src").alias("src"), F.col("dst").alias("dst")),
            F.struct(F.lit("PURCHASE").alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst")),
        )
    ).alias("s")
    return sales.select(sides, *rest).select("s.type", "s.src", "s.dst", *rest)


def read_commercial(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Commercial rows: Sale gives two edges, an unknown type none; blank numbers are 0."""
    raw = _csv(spark, path, "kind string, src long, dst long, topic long, day string, lat double, lon double, amount double")
    sales = raw.filter((F.col("kind") == "Sale") & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
        "src",
        "dst",
        F.coalesce("topic", F.lit(0)).cast("long").alias("topic"),
        F.try_to_timestamp("day", F.lit("M/d/yyyy")).cast("date").alias("date"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
    )
    both = sale_pairs(sales)
    person = F.lit("PERSON")
    fixed = {"src_type": person, "dst_type": person, "weight": F.lit(0.0), **{c: F.lit(None).cast("long") for c in _FLOW}}
    return both.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in EDGE_COLUMNS])


def read_cyber(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = _csv(spark, path, ", ".join(f"{c} long" for c in ["src", "dst", *_FLOW]))
    return _edge(raw, "COMMUNICATION", "DEVICE", "DEVICE", src=F.col("src"), dst=F.col("dst"), **{c: F.col(c) for c in _FLOW})


def read_social(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = _csv(spark, path, "src long, dst long")
    return _edge(raw, "FRIEND", "PERSON", "PERSON", src=F.col("src"), dst=F.col("dst"))


def read_uses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = _csv(spark, path, "src long, dst long")
    return _edge(raw, "USES", "PERSON", "DEVICE", src=F.col("src"), dst=F.col("dst"))


def read_nodes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(type, id): everything that is not a Device is a PERSON; surplus columns are ignored."""
    raw = _csv(spark, path, "kind string, id long, _3 string, _4 string, _5 string, _6 string, _7 string")
    return raw.filter(F.col("id").isNotNull()).select(F.when(F.col("kind") == "Device", "DEVICE").otherwise("PERSON").alias("type"), "id")


@dataclass
class InputFiles:
    """A directory with the five fixed names and/or explicit paths for each kind; both are used."""

    directory: str | None = None
    commercial: list[str] = field(default_factory=list)
    cyber: list[str] = field(default_factory=list)
    social: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    nodes: list[str] = field(default_factory=list)

    def paths(self, kind: str) -> list[str]:
        fixed = [f"{self.directory}/{kind}.csv"] if self.directory else []
        return fixed + list(getattr(self, kind))


def import_graph(spark: SparkSession, files: InputFiles) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all given files."""
    readers = {"commercial": read_commercial, "cyber": read_cyber, "social": read_social, "uses": read_uses}
    edges = None
    for kind, read in readers.items():
        if paths := files.paths(kind):
            part = read(spark, paths)
            edges = part if edges is None else edges.unionByName(part, allowMissingColumns=True)
    if edges is None:
        raise ValueError("no edge file was given")
    nodes = read_nodes(spark, files.paths("nodes")) if files.paths("nodes") else extract_nodes(edges)
    return nodes, edges


def extract_nodes(edges: DataFrame) -> DataFrame:
    """Distinct (type, id) of all end points."""
    ends = F.explode(F.array(F.struct(F.col("src_type").alias("type"), F.col("src").alias("id")), F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("id"))))
    return edges.select(ends.alias("n")).select("n.type", "n.id").distinct()

"""The data model: a property graph is a pair of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``vertices(id long, attr...)`` and ``edges(src long, dst long, w double)``.

    A directed multigraph: parallel edges and self-loops stay. Vertex ids cover ``0..max(src, dst)``,
    so ids that no edge names are isolated vertices.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, partitions: int | None = None) -> Graph:
        """Build from ``(src, dst[, w])``; a missing or null weight is 1.0, every vertex starts with its own id."""
        w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w"))
        e = e.where("src is not null and dst is not null")
        e = e.repartition(partitions, "src") if partitions else e
        return Graph(universe(e), e)

    # -- projections ---------------------------------------------------------------------------
    def map_vertices(self, **cols: Column) -> Graph:
        return replace(self, vertices=self.vertices.withColumns(cols))

    def map_edges(self, **cols: Column) -> Graph:
        return replace(self, edges=self.edges.withColumns(cols))

    def map_triplets(self, **cols: Column) -> Graph:
        """Edge columns from ``src_attr`` and ``dst_attr``; only the endpoint attributes in use are joined."""
        e = self.triplets().withColumns(cols)
        return replace(self, edges=e.select(*dict.fromkeys([*self.edges.columns, *cols])))

    def filter_vertices(self, condition: Column | str) -> DataFrame:
        return self.vertices.where(condition)

    # -- joins ---------------------------------------------------------------------------------
    def triplets(self, attr: str = "attr") -> DataFrame:
        """``(src, dst, w, src_attr, dst_attr)``: two equi-joins."""
        v = self.vertices.select("id", attr)
        s = v.select(F.col("id").alias("src"), F.col(attr).alias("src_attr"))
        d = v.select(F.col("id").alias("dst"), F.col(attr).alias("dst_attr"))
        return self.edges.join(s, "src").join(d, "dst").select(*self.edges.columns, "src_attr", "dst_attr")

    def join_vertices(self, messages: DataFrame, **cols: Column) -> Graph:
        """Update only the vertices that have a row in ``messages(id, ...)``; the others stay as they are."""
        m = messages.withColumn("_hit", F.lit(True))
        joined = self.vertices.join(m, "id", "left")
        out = [F.when(F.col("_hit"), cols[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in self.vertices.columns]
        return replace(self, vertices=joined.select(*out))

    def outer_join_vertices(self, table: DataFrame, default: dict[str, object]) -> DataFrame:
        """Every vertex with the columns of ``table(id, ...)``, ``default`` where there is no row."""
        joined = self.vertices.join(table, "id", "left")
        return joined.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in default.items()})

    # -- degrees and counts --------------------------------------------------------------------
    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def reverse(self) -> Graph:
        e = self.edges
        return replace(self, edges=e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")]))

    def wash(self) -> Graph:
        """Merge parallel edges; the smallest weight stays, so the result does not depend on row order."""
        return replace(self, edges=self.edges.groupBy("src", "dst").agg(F.min("w").alias("w")))

    def cardinalities(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("n_vertices")).join(self.edges.agg(F.count("*").alias("n_edges")))

    def degree_weights(self) -> Graph:
        """Edge weight 1 / out-degree of the source, parallel edges counted."""
        d = self.out_degrees().select(F.col("id").alias("src"), "degree")
        e = self.edges.join(d, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("w"))
        return replace(self, edges=e)

    # -- memory --------------------------------------------------------------------------------
    def persist(self, eager: bool = False) -> Graph:
        """Cache both tables; ``eager`` computes them now."""
        out = replace(self, vertices=self.vertices.persist(), edges=self.edges.persist())
        if eager:
            out.vertices.count(), out.edges.count()
        return out

    def close(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()


def max_id(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_id"))


def universe(edges: DataFrame) -> DataFrame:
    """``0..max(src, dst)``; no rows for an empty edge table. One scalar reaches the driver."""
    top = max_id(edges).first()[0]
    return edges.sparkSession.range(0, 0 if top is None else top + 1).select("id", F.col("id").alias("attr"))

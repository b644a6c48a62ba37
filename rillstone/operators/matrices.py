"""Matrices as cells (i, j, v) and graphs as edges (src, dst, w)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_matrix(log: DataFrame) -> DataFrame:
    """Of a change log (i, j, v, _seq, _outdated) the cells that are left."""
    last = log.groupBy("i", "j").agg(F.max_by(F.struct("v", "_outdated"), "_seq").alias("r"))
    return last.filter("not r._outdated").select("i", "j", "r.v")


def matrix_slice(cells: DataFrame, parts: dict[int, Column]) -> DataFrame:
    """part: the first of the predicates that holds; cells outside all go."""
    part = F.coalesce(*[F.when(p, F.lit(k)) for k, p in parts.items()])
    return cells.withColumn("part", part).filter("part is not null")


def matrix_merge(slices: DataFrame, n: int, by: str = "id") -> DataFrame:
    """Matrices of which all n parts are there."""
    whole = slices.groupBy(by).agg(F.count_distinct("part").alias("n")).filter(F.col("n") == n).select(by)
    return slices.join(whole, by).drop("part")


def remove_row(cells: DataFrame, r: int) -> DataFrame:
    return cells.filter(F.col("i") != r).withColumn("i", F.when(F.col("i") > r, F.col("i") - 1).otherwise(F.col("i")))


def remove_col(cells: DataFrame, c: int) -> DataFrame:
    return cells.filter(F.col("j") != c).withColumn("j", F.when(F.col("j") > c, F.col("j") - 1).otherwise(F.col("j")))


def insert_row(cells: DataFrame, r: int) -> DataFrame:
    """An empty row ahead of row r."""
    return cells.withColumn("i", F.when(F.col("i") >= r, F.col("i") + 1).otherwise(F.col("i")))


def insert_col(cells: DataFrame, c: int) -> DataFrame:
    return cells.withColumn("j", F.when(F.col("j") >= c, F.col("j") + 1).otherwise(F.col("j")))


def resize(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    return cells.filter((F.col("i") < rows) & (F.col("j") < cols))


def get_cell(cells: DataFrame, i: int, j: int) -> float:
    """0 for a cell that is not there."""
    row = cells.filter((F.col("i") == i) & (F.col("j") == j)).select("v").head()
    return row.v if row else 0.0


def remove_cell(cells: DataFrame, i: int, j: int) -> DataFrame:
    return cells.filter(~((F.col("i") == i) & (F.col("j") == j)))


def set_cell(cells: DataFrame, i: int, j: int, v: float) -> DataFrame:
    new = cells.sparkSession.range(1).select(*[F.lit({"i": i, "j": j, "v": v}[f.name]).cast(f.dataType).alias(f.name) for f in cells.select("i", "j", "v").schema.fields])
    return remove_cell(cells, i, j).select("i", "j", "v").unionByName(new)


def non_zeros(cells: DataFrame) -> int:
    return cells.filter("v <> 0").count()


def equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> bool:
    """Cells that are not there are 0."""
    both = a.select("i", "j", "v").join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"], "full")
    return both.filter(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) > tolerance).isEmpty()


@dataclass(frozen=True)
class Graph:
    """A square matrix read as edges (src, dst, w) between vertices 0 to n - 1."""

    edges: DataFrame
    n: int

    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(self.n).withColumnRenamed("id", "node")

    def num_vertices(self) -> int:
        return self.n

    def num_edges(self) -> int:
        return self.edges.count()

    def out_edges(self, v: int) -> DataFrame:
        return self.edges.filter(F.col("src") == v)

    def in_edges(self, v: int) -> DataFrame:
        return self.edges.filter(F.col("dst") == v)

    def adjacent(self, v: int) -> DataFrame:
        return self.out_edges(v).select(F.col("dst").alias("node")).distinct()

    def out_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))

    def in_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))

    def add_edge(self, a: int, b: int, w: float = 0.0) -> Graph:
        return self.add_edges(self.edges.sparkSession.createDataFrame([(a, b, float(w))], "src long, dst long, w double"))

    def add_edges(self, new: DataFrame) -> Graph:
        """An edge there was gets the new weight."""
        old = self.edges.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
        return Graph(old.select("src", "dst", "w").unionByName(new.select("src", "dst", "w")), self.n)

    def remove_edge(self, a: int, b: int) -> Graph:
        """In both directions."""
        return self.remove_edges_if(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)))

    def remove_edges_if(self, predicate: Column) -> Graph:
        return Graph(self.edges.filter(~F.coalesce(predicate, F.lit(False))), self.n)

    def clear_vertex(self, v: int) -> Graph:
        return self.remove_edges_if((F.col("src") == v) | (F.col("dst") == v))


def image_filter(cells: DataFrame, kind: str = "mean", radius: int = 1) -> DataFrame:
    """Each cell from its neighbourhood: mean, median, gauss or laplace. A cell is sent to its neighbours, then one shuffle gathers them."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    sent = cells.select("i", "j", "v", F.explode(d).alias("di")).select("i", "j", "v", "di", F.explode(d).alias("dj"))
    weight = {"gauss": F.exp(-(F.col("di") ** 2 + F.col("dj") ** 2) / 2.0), "laplace": F.when((F.col("di") == 0) & (F.col("dj") == 0), -4.0).when(F.abs("di") + F.abs("dj") == 1, 1.0).otherwise(0.0)}.get(kind, F.lit(1.0))
    sent = sent.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "v", weight.alias("w"))
    value = {"median": F.median("v"), "laplace": F.sum(F.col("v") * F.col("w"))}.get(kind, F.sum(F.col("v") * F.col("w")) / F.sum("w"))
    return sent.groupBy("i", "j").agg(value.alias("v")).join(cells.select("i", "j"), ["i", "j"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """node, dist from source: relaxation by joins until nothing changes, however long a path; each round is cut by a checkpoint. Weights are not negative."""
    spark = edges.sparkSession
    dist = spark.createDataFrame([(source, 0.0)], "node long, dist double")
    best = None
    while True:
        step = dist.join(edges, F.col("node") == F.col("src")).select(F.col("dst").cast("long").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        dist = _cut(dist.unionByName(step).groupBy("node").agg(F.min("dist").alias("dist")))
        state = dist.agg(F.count(F.lit(1)), F.sum("dist")).first()
        if state == best:
            break
        best = state
    return dist


def spanning_tree(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest by Boruvka rounds: each component takes its least edge, then components are joined by pointer jumping."""
    e = _cut(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))
    label = _cut(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct().withColumn("c", F.col("node")))
    tree = None
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("c").alias("ca")), label.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        out = _cut(e.join(la, "a").join(lb, "b").filter("ca <> cb"))
        if out.isEmpty():
            break
        both = out.select(F.col("ca").alias("c"), F.struct("w", "a", "b", F.col("cb").alias("to")).alias("x")).unionByName(out.select(F.col("cb").alias("c"), F.struct("w", "a", "b", F.col("ca").alias("to")).alias("x")))
        pick = _cut(both.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.*"))
        new = pick.select("a", "b", "w").distinct()
        tree = _cut(new if tree is None else tree.unionByName(new).distinct())
        # A pair that picked each other is rooted at its smaller one.
        up = pick.alias("p").join(pick.select(F.col("c").alias("q"), F.col("to").alias("back")), F.col("to") == F.col("q"), "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        up = _cut(up)
        while True:
            jumped = _cut(up.alias("x").join(up.select(F.col("c").alias("m"), F.col("up").alias("top")), F.col("x.up") == F.col("m"), "left").select("c", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
            up, moved = jumped.drop("moved"), not jumped.filter("moved").isEmpty()
            if not moved:
                break
        label = _cut(label.join(up, "c", "left").select("node", F.coalesce("up", "c").alias("c")))
    return tree if tree is not None else e.limit(0)


def _cut(df: DataFrame) -> DataFrame:
    from rillstone.sources.context import checkpointed

    return checkpointed(df)

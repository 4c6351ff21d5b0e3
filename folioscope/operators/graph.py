"""Citation graph: edges (src cites dst), hops, paths and closures."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hops from each end, and levels of a breadth-first search, at most.
MOST_HOPS = 5


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names, where lineage of loops is cut; a local session may have its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="folioscope-"))
    return spark.sparkContext.getCheckpointDir()


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """K3: an edge that is there already is ignored."""
    return edges.unionByName(new).dropDuplicates(["src", "dst"])


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b), from a node to a neighbour: its references, what cites it, or both."""
    refs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    cites = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"refs": refs, "cites": cites, "both": refs.unionAll(cites)}[direction]


def neighbours(papers: DataFrame, edges: DataFrame, node: object, direction: str, limit: int | None = None) -> DataFrame:
    """The papers next to one, most cited first, null counts last, ties by id. Repeated
    edges give repeated rows."""
    near = oriented(edges, direction).where(F.col("a") == F.lit(node)).select(F.col("b").alias("id"))
    out = near.join(papers, "id").orderBy(F.desc_nulls_last("citation_count"), "id")
    return out.limit(limit) if limit is not None else out


def closure(papers: DataFrame, edges: DataFrame, seeds: list, direction: str = "both", min_year: int = 0, limit: int | None = None) -> DataFrame:
    """Papers next to any seed, with linked_seeds and seed_count, most seeds first, then most
    cited, then id. Seeds are left out; a null year passes min_year; no seeds, no rows.

    One scan of the edges: seeds are few and go into the filter."""
    linked = oriented(edges, direction).where(F.col("a").isin(seeds) & ~F.col("b").isin(seeds)).distinct()
    counted = linked.groupBy("b").agg(F.sort_array(F.collect_list("a")).alias("linked_seeds"), F.count("*").alias("seed_count"))
    wanted: Column = F.lit(True) if not min_year else F.col("year").isNull() | (F.col("year") >= min_year)
    out = counted.join(papers.where(wanted), F.col("b") == F.col("id")).drop("b").orderBy(F.desc("seed_count"), F.desc_nulls_last("citation_count"), "id")
    return out.limit(limit) if limit is not None else out


def hops(edges: DataFrame, roots: DataFrame, direction: str = "refs", most: int = MOST_HOPS, most_nodes: int | None = None) -> DataFrame:
    """(node, level), each node once, at its distance from the nearest root (level 0). An edge to a
    node without an id is a row of its own (node null), and leads no further.

    The order that the cap follows is (level, node). A level is a join with the edges and an
    anti join with what is known; nothing but a count comes to the driver."""
    checkpoint_folder(edges.sparkSession)
    every = oriented(edges, direction).where("a is not null")
    #: Oriented once and written: each level reads it instead of making it again.
    steps = every.where("b is not null").distinct().checkpoint()
    loose = every.where("b is null").checkpoint()
    some_loose = not loose.isEmpty()
    known = roots.select(F.col(roots.columns[0]).alias("node"), F.lit(0).alias("level")).distinct()
    frontier, unnamed = known, known.limit(0)
    for level in range(1, most + 1):
        if some_loose:
            unnamed = unnamed.unionAll(frontier.join(loose, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(level).alias("level")))
        reached = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = reached.join(known.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level")).checkpoint()
        if frontier.isEmpty():
            break
        known = known.unionAll(frontier)
        if most_nodes is not None and known.count() + (unnamed.count() if some_loose else 0) - 1 >= most_nodes:
            break
    out = known.unionAll(unnamed) if some_loose else known
    return out if most_nodes is None else out.where("level = 0").unionAll(out.where("level > 0").orderBy("level", "node").limit(most_nodes))


def shortest_path(edges: DataFrame, start: object, end: object, most: int = MOST_HOPS) -> DataFrame:
    """(place, node) along a shortest undirected path; of several, the one with the smallest ids
    from the meeting place outwards. No path within `most` hops of each end: no rows. A node is
    its own path.

    Two frontiers grow in turn, each node with its smallest parent, until they meet."""
    spark = edges.sparkSession
    checkpoint_folder(spark)
    kind = edges.schema["src"].dataType
    steps = oriented(edges, "both").distinct().checkpoint()
    sides = [spark.range(1).select(F.lit(x).cast(kind).alias("node"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("level")) for x in (start, end)]
    fronts = list(sides)
    meeting = None
    for turn in range(2 * most + 1):
        met = sides[0].select("node").join(sides[1].select("node"), "node").agg(F.min("node")).first()[0]
        if met is not None:
            meeting = met
            break
        if turn == 2 * most:
            break
        k = turn % 2
        new = fronts[k].join(steps, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        fronts[k] = new.join(sides[k].select("node"), "node", "left_anti").select("node", "parent", F.lit(turn // 2 + 1).alias("level")).checkpoint()
        if fronts[k].isEmpty():
            break
        sides[k] = sides[k].unionAll(fronts[k])
    if meeting is None:
        return spark.createDataFrame([], f"place int, node {kind.simpleString()}")
    #: one row with the way back on both sides, as many joins with the levels as there were turns
    way = spark.range(1).select(F.lit(meeting).cast(kind).alias("a0"), F.lit(meeting).cast(kind).alias("b0"))
    for k, name in ((0, "a"), (1, "b")):
        for n in range(turn // 2 + turn % 2 * (1 - k)):
            way = way.join(sides[k].select(F.col("node").alias(f"{name}{n}"), F.col("parent").alias(f"{name}{n + 1}")), f"{name}{n}", "left")
    row = way.first().asDict()
    back = [[row[f"{c}{n}"] for n in range(1, len(row)) if row.get(f"{c}{n}") is not None] for c in "ab"]
    return spark.createDataFrame(list(enumerate([*reversed(back[0]), meeting, *back[1]])), f"place int, node {kind.simpleString()}")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) can reach.

    Stars: every node is hooked to the least neighbour (or itself), larger neighbours first, then
    smaller ones, until the stars stop changing, which takes few rounds even for long chains. Every
    round is written to the shared folder; the sums of a star combine before the shuffle."""
    checkpoint_folder(edges.sparkSession)
    dealt = lambda sums: sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(dealt(lower), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("the components did not settle")

"""Communities by modularity as rounds of joins: parallel local moving, refinement, contraction (Leiden), at any size.

A round sums each node's links to the communities around it, gives each node the move that gains most, and carries out those of
an independent set: two linked nodes are at odds if one leaves what the other joins, and only the one of higher priority, a hash of
seed, round and node, moves. Links that a gain counts on can thus not leave in the same round. A round that lowers the
modularity is taken back.
Refinement starts from single nodes and lets only these move, within their community, so its parts are connected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matriq.lineage import cut, drop

#: Rounds of a phase, and levels of contraction, at most; phases end when nothing moves, levels when nothing shrinks.
ROUNDS, LEVELS = 60, 20
#: Modularity that a round must add for another to follow.
LEAST_GAIN = 5e-4
#: Rows of a side that is broadcast, after they are counted.
FEW = 20_000
#: Times that a losing round is halved.
HALVES = 4
#: Gains below this share of the total weight are none.
LEAST = 1e-12


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _with_sums(nodes: DataFrame) -> DataFrame:
    """nodes (u, c, k, ...) with `all`, the degrees of the node's community together."""
    sums = nodes.groupBy(F.col("c").alias("_c")).agg(F.sum("k").alias("all"))
    return nodes.drop("all").join(sums, F.col("c") == F.col("_c")).drop("_c")


def _priority(seed: int, turn: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(turn), "u")


class Level:
    """A graph of nodes (u, k: degree with loops, loop) and edges (u, v, w) both ways without loops, of total weight `total`."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, total: float, resolution: float, seed: int, name: str):
        self.nodes, self.edges, self.total, self.resolution, self.seed, self.name = nodes, edges, total, resolution, seed, name

    def offers(self, state: DataFrame, edges: DataFrame) -> DataFrame:
        """(u, c, k, all, own, to, gain): each node's links to its own community and its best move, which may be none."""
        at = state.select(F.col("u").alias("v"), "c", F.col("all").alias("_all"), F.col("part").alias("_part"))
        links = edges.join(at, "v").groupBy("u", F.col("c").alias("to")).agg(F.sum("w").alias("l"), F.first("_all").alias("sum"))
        here = state.select("u", "c", "k", "all", "part", "loop")
        both = here.join(links, "u", "left")
        mine = F.col("to") == F.col("c")
        own = F.coalesce(F.sum(F.when(mine, F.col("l"))), F.lit(0.0))
        cost = self.resolution / self.total
        value = F.col("l") - F.col("k") * F.col("sum") * cost
        best = F.max(F.when(~mine, F.struct(value.alias("value"), (-F.col("to")).alias("_low"))))
        out = both.groupBy("u", "c", "k", "all", "part", "loop").agg(own.alias("own"), best.alias("b"))
        stay = F.col("own") - F.col("k") * (F.col("all") - F.col("k")) * cost
        return out.select("u", "c", "k", "all", "part", "loop", "own", (-F.col("b._low")).alias("to"), (F.col("b.value") - stay).alias("gain"))

    def offered(self, state: DataFrame, edges: DataFrame, wish: Column) -> tuple[DataFrame, float, int]:
        """(offers(), written once; modularity of the state's communities; how many nodes wish to move). The figures are observed as offers are written."""
        seen = Observation()
        sums = F.sum(F.col("own") + F.col("loop")).alias("inner"), F.sum(F.col("k") * F.col("all")).alias("outer"), F.count_if(wish).alias("n")
        made = cut(self.offers(state, edges).observe(seen, *sums))
        got = seen.get
        return made, got["inner"] / self.total - self.resolution * got["outer"] / self.total**2, got["n"]

    def moved(self, offers: DataFrame, edges: DataFrame, turn: str, wish: Column, n: int) -> DataFrame:
        """The state after the moves of an independent set of the n nodes that wish to move."""
        few = F.broadcast if n <= FEW else lambda t: t
        side = few(offers.where(wish).select("u", F.col("c").alias("out"), "to", _priority(self.seed, turn).alias("p")))
        # One table under two names, so that it is made once.
        both = edges.alias("e").join(side.alias("a"), F.col("e.u") == F.col("a.u")).join(side.alias("b"), F.col("e.v") == F.col("b.u"))
        beaten = both.where("(b.out = a.to OR b.to = a.out) AND (b.p > a.p OR (b.p = a.p AND b.u > a.u))").select("a.u").distinct().withColumn("_beaten", F.lit(True))
        goes = wish & F.col("_beaten").isNull()
        out = offers.join(few(beaten), "u", "left").select("u", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c"), "k", "part", "loop")
        return cut(_with_sums(out))

    def settled(self, labels: DataFrame) -> tuple[DataFrame, float]:
        """((u, c), modularity) after local moving from labels (u, c).

        Moves of a round meet in the sums of communities alone; a round that loses by that is done again with half of the wishes.
        """
        state = cut(_with_sums(self.nodes.join(labels, "u").withColumn("part", F.lit(0))))
        best, kept, share, offers = float("-inf"), None, 0, None
        for k in range(ROUNDS):
            wish = F.col("gain") > LEAST * self.total
            made, now, n = self.offered(state, self.edges, wish)
            drop(state)
            if now > best + LEAST:
                if kept is not None:
                    drop(kept)
                small = now < best + LEAST_GAIN
                best, kept, share, offers, wishes = now, made, max(0, share - 1), made, n
                if small:
                    break
            else:
                drop(made)
                share += 1
            if not wishes or share > HALVES:
                break
            some = wish & (F.pmod(_priority(self.seed, f"{self.name} half {k}"), F.lit(1 << share)) == 0)
            state = self.moved(offers, self.edges, f"{self.name} move {k}", some, wishes)
        return kept.select("u", "c"), best

    def refined(self, labels: DataFrame) -> DataFrame:
        """(u, c, part) with connected parts c of the communities `part`, as singles that joined others of their community."""
        of = labels.select("u", F.col("c").alias("part"))
        ends = of.select(F.col("u").alias("v"), F.col("part").alias("_part"))
        inner = cut(self.edges.join(of, "u").join(ends, "v").where("part = _part").select("u", "v", "w"))
        state = cut(_with_sums(self.nodes.join(of, "u").withColumn("c", F.col("u"))))
        single = F.col("all") <= F.col("k") * (1 + 1e-9)
        wish = single & (F.col("gain") > LEAST * self.total)
        for k in range(ROUNDS):
            offers, _, n = self.offered(state, inner, wish)
            if not n:
                drop(offers)
                break
            after = self.moved(offers, inner, f"{self.name} part {k}", wish, n)
            drop(state, offers)
            state = after
        drop(inner)
        return state.select("u", "c", "part")


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(cell_id, c): communities of the graph of edges (src, dst, w), named by one of their nodes. Nodes without edges are alone.

    Both directions of an edge count half; loops count nothing. Edges of no weight and null ends are left out.
    """
    plain = edges.where("src <> dst AND w > 0").select(F.col("src").alias("u"), F.col("dst").alias("v"), (F.col("w").cast("double") / 2).alias("w"))
    e = cut(plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    degree = e.groupBy("u").agg(F.sum("w").alias("k"))
    n = cut(degree.select("u", "k", F.lit(0.0).alias("loop")))
    total = n.agg(F.sum("k")).first()[0] or 0.0
    every = nodes.select(F.col("cell_id").cast("long").alias("cell_id")).where("cell_id IS NOT NULL").distinct()
    if not total:
        return every.select("cell_id", F.col("cell_id").alias("c"))
    alone = n.select(F.col("u").alias("cell_id"), F.col("u").alias("c"))
    found = _levels(n, e, total, alone, resolution, seed)
    # Once more node by node: what contraction has moved as a whole may fit better elsewhere.
    found = Level(n, e, total, resolution, seed, "last").settled(found.select(F.col("cell_id").alias("u"), "c"))[0]
    return every.join(found.withColumnRenamed("u", "cell_id"), "cell_id", "left").select("cell_id", F.coalesce("c", "cell_id").alias("c"))


def _levels(n: DataFrame, e: DataFrame, total: float, start: DataFrame, resolution: float, seed: int) -> DataFrame:
    """(cell_id, c) after moving, refining and contracting from the communities `start` until every community is one node."""
    member = n.select(F.col("u").alias("cell_id"), "u")  # node of the present level that a cell is in
    labels, best, found = start.select(F.col("cell_id").alias("u"), "c"), float("-inf"), start
    size, scratch = n.count(), []
    for k in range(LEVELS):
        level = Level(n, e, total, resolution, seed, f"level {k}")
        labels, quality = level.settled(labels)
        if quality > best:
            found, best = cut(member.join(labels, "u").select("cell_id", "c")), quality
        few = labels.select("c").distinct().count()
        if few == size:
            break
        parts = level.refined(labels)
        smaller = parts.select("c").distinct().count()
        if smaller == size:  # communities of parts that don't join: they are contracted as they are
            parts, smaller = labels.withColumn("part", F.col("c")), few
        size = smaller
        into = parts.select("u", F.col("c").alias("to"))
        member = cut(member.join(into, "u").select("cell_id", F.col("to").alias("u")))
        moved = cut(e.join(into, "u").join(into.select(F.col("u").alias("v"), F.col("to").alias("_v")), "v").groupBy(F.col("to").alias("u"), F.col("_v").alias("v")).agg(F.sum("w").alias("w")))
        loops = moved.where("u = v").select("u", F.col("w").alias("_in"))
        sums = n.join(into, "u").groupBy(F.col("to").alias("u")).agg(F.sum("k").alias("k"), F.sum("loop").alias("_l"))
        n = cut(sums.join(loops, "u", "left").select("u", "k", (F.col("_l") + F.coalesce("_in", F.lit(0.0))).alias("loop")))
        e = moved.where("u <> v")
        # A part's community is that of its nodes; it is named by one of its parts, so names stay nodes of the level.
        of = parts.groupBy("c").agg(F.first("part").alias("part"))
        names = of.groupBy("part").agg(F.min("c").alias("name"))
        labels = cut(of.join(names, "part").select(F.col("c").alias("u"), F.col("name").alias("c")))
        scratch += [member, moved, n, labels]
    drop(*scratch)
    return found


def ranked(found: DataFrame) -> DataFrame:
    """(cell_id, cluster): communities numbered as text from the largest, 0; of equal ones that with the smallest cell first.

    Numbers are found among the communities, one row each; the sort of many is by ranges.
    """
    sizes = cut(found.groupBy("c").agg(F.count("*").alias("n"), F.min("cell_id").alias("first")).orderBy(F.col("n").desc(), "first"))
    parts = cut(sizes.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    begins: dict[int, int] = {}
    total = 0
    for r in sorted(parts.groupBy("_p").count().collect()):  # one row a partition
        begins[r["_p"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in begins.items() for x in kv)), F.col("_p")) if begins else F.lit(0)
    number = parts.select("c", (F.col("_i").bitwiseAND((1 << 33) - 1) + start).cast("string").alias("cluster"))
    return found.join(_few(number), "c").select("cell_id", "cluster")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (cell_id, cluster) on the graph that leiden() sees."""
    plain = edges.where("src <> dst AND w > 0").select("src", "dst", F.col("w").cast("double").alias("w"))
    a = labels.select(F.col("cell_id").alias("src"), F.col("cluster").alias("_a"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("_b"))
    both = plain.join(a, "src").join(b, "dst")
    total, inner = both.agg(F.sum("w"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")))).first()
    ends = both.select(F.explode(F.array("_a", "_b")).alias("c"), (F.col("w") / 2).alias("w"))
    outer = ends.groupBy("c").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return (inner or 0.0) / total - resolution * outer / total**2 if total else 0.0

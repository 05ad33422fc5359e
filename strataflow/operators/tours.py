"""Trees by their Euler tours: each node has an arc down and an arc up, and a tour walks a tree's arcs in order.

Every arc knows the next one, so sums over all arcs to the end of the tour come from list ranking: in each round an arc adds
the sum of the arc it points to and then points as far as that one does.  Rounds are the logarithm of the longest tour, whatever the
shape of the trees; a subtree's sum is the difference of its two arcs.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.scan import scanned
from strataflow.operators.scratch import cut

#: Arcs whose text one piece holds.
PIECE = 10_000


def tours(edges: DataFrame, sums: dict[str, Column] | None = None, rounds: int = 64) -> DataFrame:
    """One row per node of the forest (child, parent, time): these three, ``root``, ``depth``, ``first`` and ``last`` (its arcs'
    distances from the end of the tour, so tours run from great to small), ``size`` (nodes of its subtree), ``prev`` (the sibling
    before it), ``is_leaf``, ``known``, and for each entry of ``sums`` the sum of that column over its subtree.

    Children stand in order of their names.  A parent without a row of its own is a root without a time, and not ``known``.
    """
    sums = sums or {}
    rows = edges.select("child", "parent", "time", F.lit(True).alias("known"), *[F.coalesce(c, F.lit(0)).cast("double").alias(f"_w_{n}") for n, c in sums.items()])
    named = rows.where("parent is not null").select(F.col("parent").alias("child")).distinct().join(rows.select("child"), "child", "left_anti")
    none = [F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in ("parent", "time")]
    rows = cut(rows.unionByName(named.select("child", *none, F.lit(False).alias("known"), *[F.lit(0.0).alias(f"_w_{n}") for n in sums])))
    below = rows.where("parent is not null").select("child", "parent")
    after = scanned(below, ["parent"], [F.col("child").desc()], {"next": ("before", "child")}).select("child", "next")
    before = scanned(below, ["parent"], [F.col("child").asc()], {"prev": ("before", "child")}).select("child", "prev")
    eldest = below.groupBy(F.col("parent").alias("child")).agg(F.min("child").alias("eldest"))
    nodes = cut(rows.join(after, "child", "left").join(before, "child", "left").join(eldest, "child", "left"))
    kind = edges.schema["child"].dataType.simpleString()
    arc = lambda node, up: F.struct(node.cast(kind).alias("node"), F.lit(up).alias("up"))
    down_next = F.when(F.col("eldest").isNotNull(), arc(F.col("eldest"), False)).otherwise(arc(F.col("child"), True))
    up_next = F.when(F.col("next").isNotNull(), arc(F.col("next"), False)).when(F.col("parent").isNotNull(), arc(F.col("parent"), True))
    carried = {"_at": (F.lit(1), F.lit(1)), "_deep": (F.lit(1), F.lit(-1)), "_size": (F.lit(1), F.lit(0))} | {f"_s_{n}": (F.col(f"_w_{n}"), F.lit(0.0)) for n in sums}
    kinds = {n: "double" if n.startswith("_s_") else "long" for n in carried}
    sides = [nodes.select(F.col("child").alias("node"), F.lit(up).alias("up"), to.alias("to"), F.col("child").alias("end"), *[v[up].cast(kinds[n]).alias(n) for n, v in carried.items()]) for up, to in ((False, down_next), (True, up_next))]
    now = cut(sides[0].unionByName(sides[1]))
    for _ in range(rounds):
        ahead = now.select(F.struct("node", "up").alias("_key"), F.col("to").alias("_to"), F.col("end").alias("_end"), *[F.col(n).alias(f"_a{n}") for n in carried])
        ahead = ahead.withColumns({"_node": F.col("_key.node"), "_up": F.col("_key.up")}).drop("_key")
        met = now.join(ahead, (F.col("to.node") == F.col("_node")) & (F.col("to.up") == F.col("_up")), "left")
        now = cut(met.select("node", "up", F.col("_to").alias("to"), F.coalesce("_end", "end").alias("end"), *[(F.col(n) + F.coalesce(F.col(f"_a{n}"), F.lit(0).cast(kinds[n]))).alias(n) for n in carried]))
        if now.where("to is not null").isEmpty():
            break
    else:
        raise ValueError("the parent links have a cycle")
    pick = lambda c, up: F.max(F.when(F.col("up") == F.lit(up), F.col(c)))
    found = now.groupBy(F.col("node").alias("child")).agg(
        F.max("end").alias("root"), (-pick("_deep", False)).alias("depth"), pick("_at", False).alias("first"), pick("_at", True).alias("last"), (pick("_size", False) - pick("_size", True)).alias("size"),
        *[(pick(f"_s_{n}", False) - pick(f"_s_{n}", True)).alias(n) for n in sums],
    )
    return nodes.select("child", "parent", "time", "prev", F.col("eldest").isNull().alias("is_leaf"), "known").join(found, "child")


def _number(x: Column) -> Column:
    """Up to six places, without zeros at the end."""
    return F.regexp_replace(F.round(x, 6).cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def newick_pieces(toured: DataFrame, piece: int = PIECE) -> DataFrame:
    """(root, part, text): the trees' Newick texts in pieces of at most ``piece`` arcs, to be read in order of ``part``."""
    up = toured.select(F.col("child").alias("parent"), F.col("time").alias("_pt"))
    rows = toured.join(up, "parent", "left")
    branch = F.when(F.col("parent").isNotNull() & F.col("_pt").isNotNull(), F.concat(F.lit(":"), _number(F.col("time").cast("double") - F.col("_pt").cast("double"))))
    opened = F.concat(F.when(F.col("prev").isNotNull(), ",").otherwise(""), F.when(~F.col("is_leaf"), "(").otherwise(""))
    closed = F.concat(F.when(~F.col("is_leaf"), ")").otherwise(""), F.col("child").cast("string"), F.coalesce(branch, F.lit("")), F.when(F.col("parent").isNull(), ";").otherwise(""))
    arcs = rows.select("root", F.explode(F.array(F.struct(F.col("first").alias("at"), opened.alias("text")), F.struct(F.col("last").alias("at"), closed.alias("text")))).alias("a")).select("root", "a.*")
    length = toured.where("parent is null").select("root", F.col("first").alias("_length"))
    arcs = arcs.join(length, "root").withColumn("part", F.floor((F.col("_length") - F.col("at")) / piece))
    # At most ``piece`` arcs meet in one row.
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("k"), "text"))), lambda s: s["text"]), "")
    return arcs.groupBy("root", "part").agg(text.alias("text"))

"""Run catalog queries: listing, filters, globs, label history, prefix resolution, model differences, role partitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import Refused
from strataflow.operators import joins
from strataflow.operators.scratch import cut


def glob(column: Column, pattern: str) -> Column:
    """``*`` and ``?`` matching of whole texts."""
    return column.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def list_runs(runs: DataFrame, kind: str | None = None, label: str | None = None, since=None, limit: int | None = None, group: str | None = None, model: str | None = None, prefix: str | None = None, method: str | None = None, converged: bool | None = None) -> DataFrame:
    """Newest runs first; with ``group``, one row per group with its count and newest run.  The limit counts rows.

    ``model`` and ``prefix`` are beginnings of a model's name and a run's id; ``converged`` asks for runs whose verdict is so,
    and False takes those without a verdict too.
    """
    rows = runs
    if model is not None:
        rows = rows.where(F.col("model").startswith(model))
    if prefix is not None:
        rows = rows.where(F.col("run_id").startswith(prefix))
    if method is not None:
        rows = rows.where(F.col("method") == method)
    if converged is not None:
        rows = rows.where(F.coalesce(F.col("converged"), F.lit(False)) == converged)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if label is not None:
        rows = rows.where(glob(F.col("label"), label))
    if since is not None:
        rows = rows.where(F.col("created") >= since)
    if group is not None:
        rows = rows.groupBy(group).agg(F.count("*").alias("n_runs"), F.max("created").alias("created"), F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))
    rows = rows.orderBy(F.desc("created"), "run_id")
    return rows if limit is None else rows.limit(limit)


def resolve_prefix(runs: DataFrame, prefix: str, run_id: str = "run_id") -> str:
    """The one run whose id has the prefix; none or several are refused."""
    found = [r[0] for r in runs.where(F.col(run_id).startswith(prefix)).select(run_id).distinct().limit(2).collect()]
    if len(found) != 1:
        raise Refused(f"{'no' if not found else 'more than one'} run has the prefix {prefix}")
    return found[0]


def prefix_matches(runs: DataFrame, prefixes: DataFrame, run_id: str = "run_id") -> DataFrame:
    """(prefix, n_matches, status) for prefixes of one length each: an equi-join on the cut id."""
    # As many lengths as the longest id has characters at most: a longer prefix matches nothing.
    longest = runs.agg(F.max(F.length(run_id))).first()[0] or 0
    lengths = [r[0] for r in prefixes.select(F.length("prefix").alias("n")).where(F.col("n") <= longest).distinct().collect()]
    cut = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.substring(F.col(run_id), F.lit(1), n)))
    ids = runs.select(run_id).distinct().withColumn("prefix", F.explode(cut))
    out = prefixes.join(ids, "prefix", "left").groupBy("prefix").agg(F.count(run_id).alias("n_matches"))
    return out.withColumn("status", F.when(F.col("n_matches") == 0, "unknown").when(F.col("n_matches") > 1, "ambiguous").otherwise("resolved"))


def label_history(labels: DataFrame, label: str, set_at: str, run_id: str) -> DataFrame:
    """Adds ``back``: 0 for the run that a label names now, n for the one n settings ago."""
    order = W.partitionBy(label).orderBy(F.desc(set_at), F.desc(run_id))
    return labels.withColumn("back", F.row_number().over(order) - 1)


def with_quantity(runs: DataFrame, quantities: DataFrame, name: str, run_id: str = "run_id") -> DataFrame:
    """Adds a quantity's median as a column."""
    q = quantities.where(F.col("quantity") == name).groupBy(run_id).agg(F.max("q50").alias(name))
    return runs.join(q, run_id, "left")


def diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """same, changed, only_left or only_right for each key of two models."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("changed")
    return both.select(*keys, "left_value", "right_value", status.alias("status"))


def order_rows(left: DataFrame, right: DataFrame, category: str, name: str, place: str) -> DataFrame:
    """Names of both models that stand in another order among the names that both have: (category, name, left_place, right_place)."""
    both = left.select(category, name, F.col(place).alias("_l")).join(right.select(category, name, F.col(place).alias("_r")), [category, name])
    rank = lambda c: F.row_number().over(W.partitionBy(category).orderBy(c, name))
    rows = both.select(category, name, rank("_l").alias("left_place"), rank("_r").alias("right_place"))
    return rows.where("left_place <> right_place")


def not_compared(rows: DataFrame, categories: list[str], category: str = "category") -> DataFrame:
    """A diff whose rows of some categories only say that they were not compared."""
    skipped = F.col(category).isin(categories)
    return rows.withColumn("status", F.when(skipped & F.col("status").isin("same", "changed"), "not_compared").otherwise(F.col("status")))


def chain_rows(df: DataFrame, keep: list[int] | None = None, drop: list[int] | None = None, chain: str = "chain") -> DataFrame:
    """Each chain of a table with its rows and whether the selection keeps it: what a filtered file says of itself."""
    kept = joins.select_chains(df, keep, drop, chain).select(chain).distinct().withColumn("kept", F.lit(True))
    return df.groupBy(chain).agg(F.count("*").alias("n_rows")).join(kept, chain, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def affected_by(changed: DataFrame, uses: DataFrame, rounds: int = 1000) -> DataFrame:
    """(name, distance): names that use a changed name, directly or through others; uses(name, used)."""
    seen = changed.select("name").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, rounds):
        front = cut(uses.join(front.select(F.col("name").alias("used")), "used").select("name").distinct().join(seen.select("name"), "name", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise ValueError("names use each other too deeply")


def role_violations(parameters: DataFrame, roles: DataFrame) -> DataFrame:
    """Parameters that have no role or more than one, and roles of unknown parameters."""
    n = roles.groupBy("name").agg(F.count("*").alias("n_roles"))
    both = parameters.select("name", F.lit(True).alias("known")).join(n, "name", "full_outer")
    why = F.when(F.col("known").isNull(), "unknown parameter").when(F.coalesce("n_roles", F.lit(0)) == 0, "no role").when(F.col("n_roles") > 1, "several roles")
    return both.withColumn("problem", why).where("problem is not null").select("name", "problem")


def render(df: DataFrame, form: str = "text", rows: int = 1000) -> str:
    """A report as text, md, csv or json; a table of more than ``rows`` rows is refused."""
    pdf = df.limit(rows + 1).toPandas()
    if len(pdf) > rows:
        raise Refused(f"a report has at most {rows} rows; ask for more or select some")
    if form == "json":
        return pdf.to_json(orient="records")
    if form == "csv":
        return pdf.to_csv(index=False)
    if form == "md":
        head = "| " + " | ".join(pdf.columns) + " |\n|" + "---|" * len(pdf.columns) + "\n"
        return head + "".join("| " + " | ".join("NA" if x is None or x != x else str(x) for x in r) + " |\n" for r in pdf.itertuples(index=False))
    if form == "text":
        return pdf.to_string(index=False, na_rep="NA")
    raise ValueError("form must be text, md, csv or json")


def suggest(name: str, known: DataFrame, column: str, limit: int = 3) -> DataFrame:
    """Known names nearest to a misspelt one."""
    return known.select(column, F.levenshtein(F.col(column), F.lit(name)).alias("distance")).orderBy("distance", column).limit(limit)

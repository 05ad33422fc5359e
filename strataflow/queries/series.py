"""Windows, projections, reductions and forcings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import calendar, forcing
from strataflow.operators import joins, reduce, windows
from strataflow.queries import query
from strataflow.queries.base import DAILY, EVENTS, REVENUE, daily, events, revenue, rounded, table


@query(
    "flagship_incidence_bands",
    f"""WITH {DAILY}, w AS (SELECT *, 0.5 * (v + lead(v) OVER (PARTITION BY event_type ORDER BY day)) * (lead(day) OVER (PARTITION BY event_type ORDER BY day) - day) AS slab FROM daily),
    r AS (SELECT event_type, arg_max(v, day) AS final, max(v) AS mx, arg_min(day, (-v, day)) AS peak, min(day) FILTER (WHERE v > 1000) AS crossed, coalesce(sum(slab), 0) AS area FROM w GROUP BY event_type),
    l AS (UNPIVOT (SELECT event_type, final, mx AS max, CAST(peak AS DOUBLE) AS time_of_max, CAST(crossed AS DOUBLE) AS first_above, area AS integral FROM r) ON final, max, time_of_max, first_above, integral INTO NAME quantity VALUE x)
    SELECT quantity, count(*) AS n_draws, round(quantile_cont(x, 0.05), 4) AS q05, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, round(quantile_cont(x, 0.95), 4) AS q95 FROM l GROUP BY quantity""",
)
def flagship(spark, sf_dir):
    """Daily incidence by type, its temporal reductions, and their bands across types."""
    from strataflow.operators import bands

    r = reduce.reductions(daily(spark, sf_dir), ["event_type"], "day", "v", 1000.0)
    long = r.select("event_type", "final", "max", F.col("time_of_max").cast("double").alias("time_of_max"), F.col("first_above").cast("double").alias("first_above"), "integral")
    long = long.unpivot(["event_type"], ["final", "max", "time_of_max", "first_above", "integral"], "quantity", "x").where("x is not null")
    return rounded(bands.band(long, ["quantity"], "x", check=False), 4)


def _window_query(form: str, width: int):
    bounds = {"day": ("d", "d + 1"), "starting_on": ("d", f"d + {width}"), "ending_on": (f"d + 1 - {width}", "d + 1"), "closing_at": (f"d - {width}", "d")}[form]

    @query(
        f"window_{form}_sums",
        f"""WITH {EVENTS}, labels AS (SELECT DISTINCT event_type, day AS d FROM ev),
        w AS (SELECT event_type, {bounds[0]} AS start, {bounds[1]} AS stop FROM labels)
        SELECT w.event_type, w.start, w.stop, count(ev.event_id) AS n, round(sum(ev.value), 4) AS total FROM w LEFT JOIN ev ON ev.event_type = w.event_type AND ev.day >= w.start AND ev.day < w.stop GROUP BY ALL""",
    )
    def run(spark, sf_dir):
        e = events(spark, sf_dir)
        labels = e.select("event_type", "day").distinct()
        w = windows.label_window(labels, "day", form, width, 1)
        w = w.select("event_type", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
        return rounded(windows.interval_sums(e, w, ["event_type"], "day", {"total": "value"}), 4)


for _form in windows.FORMS:
    _window_query(_form, 7)


@query(
    "window_violations_by_customer",
    """WITH w AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start FROM orders),
    b AS (SELECT *, start + 30 AS stop, lag(start + 30) OVER (PARTITION BY o_custkey ORDER BY start, start + 30, o_orderkey) AS before FROM w),
    v AS (SELECT CASE WHEN before > start THEN 'overlap' WHEN before < start THEN 'gap' END AS violation FROM b)
    SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY violation""",
)
def window_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("start"))
    found = windows.window_violations(o.withColumn("stop", F.col("start") + 30), ["o_custkey"], uniform=True)
    return found.groupBy("violation").agg(F.count("*").alias("n"))


@query(
    "holes_keep_windows",
    f"""WITH {DAILY} SELECT event_type, day, CAST(CASE WHEN day % 5 = 0 THEN NULL ELSE n END AS DOUBLE) AS n, CASE WHEN day % 5 = 0 THEN NULL ELSE v END AS v, day % 5 = 0 AS is_hole FROM daily""",
)
def holes(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("n", F.col("n").cast("double")).withColumn("v", F.when(F.col("day") % 5 != 0, F.col("v")))
    return windows.holes(d, "n", ["v"])


@query(
    "cohort_bins_weekly",
    """WITH o AS (SELECT o_orderpriority AS p, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS t FROM orders),
    s AS (SELECT p, min(t) AS lo0, CAST(greatest(ceil((max(t) - min(t)) / 28.0), 1) AS BIGINT) AS bins FROM o GROUP BY p),
    c AS (SELECT o.p, least(CAST(floor((t - lo0) / 28.0) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM o JOIN s USING (p) GROUP BY 1, 2),
    g AS (SELECT p, lo0, unnest(range(bins)) AS bin FROM s)
    SELECT g.p AS o_orderpriority, g.bin, lo0 + g.bin * 28.0 AS lo, lo0 + g.bin * 28.0 + 28.0 AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.p ORDER BY g.bin) AS BIGINT) AS cumulative FROM g LEFT JOIN c ON c.p = g.p AND c.bin = g.bin""",
)
def cohort_bins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("t"))
    return windows.cohort_bins(o, ["o_orderpriority"], "t", 28.0)


@query(
    "trailing_week_revenue",
    f"""WITH {REVENUE} SELECT day, CAST(sum(price) OVER w AS DOUBLE) AS w_sum, round(avg(price) OVER w, 4) AS w_mean, CAST(max(price) OVER w AS DOUBLE) AS w_max, CAST(price AS DOUBLE) AS w_latest FROM revenue WINDOW w AS (ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def trailing_week(spark, sf_dir):
    out = windows.trailing(revenue(spark, sf_dir).withColumn("one", F.lit(1)), ["one"], "day", 7, "price")
    return rounded(out.select("day", "w_sum", "w_mean", "w_max", "w_latest"), 4)


@query(
    "trailing_sum_by_user",
    f"""WITH {EVENTS}, d AS (SELECT user_id, day, round(sum(value), 4) AS v FROM ev GROUP BY 1, 2) SELECT user_id, day, round(sum(v) OVER w, 3) AS w_sum, round(max(v) OVER w, 3) AS w_max FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def trailing_by_user(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", "day").agg(F.round(F.sum("value"), 4).alias("v"))
    return rounded(windows.trailing(d, ["user_id"], "day", 7, "v").select("user_id", "day", "w_sum", "w_max"), 3)


@query(
    "tenths_of_series",
    f"""WITH {DAILY}, p AS (SELECT event_type, v, CAST(floor(10.0 * (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1) / count(*) OVER (PARTITION BY event_type)) AS INTEGER) AS part FROM daily)
    SELECT event_type, part, round(avg(v), 4) AS mean_v, round(median(v), 4) AS median_v FROM p GROUP BY 1, 2""",
)
def tenths(spark, sf_dir):
    return rounded(windows.tenths(daily(spark, sf_dir), ["event_type"], "day").groupBy("event_type", "part").agg(F.avg("v").alias("mean_v"), F.median("v").alias("median_v")), 4)


@query(
    "flow_ratio_monthly",
    """WITH l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_quantity AS q, l_returnflag AS f FROM lineitem)
    SELECT month, round(CASE WHEN sum(q) FILTER (WHERE f IN ('R', 'A')) > 0 THEN coalesce(sum(q) FILTER (WHERE f = 'R'), 0) / sum(q) FILTER (WHERE f IN ('R', 'A')) END, 6) AS share FROM l GROUP BY month""",
)
def flow_ratio(spark, sf_dir):
    """Ratio of two cumulative flows per window; missing where the denominator is 0."""
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    of = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0.0))
    out = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(windows.ratio(of(f == "R"), of(f.isin("R", "A"))).alias("share"))
    return rounded(out)


@query(
    "emission_schedule",
    f"""WITH {EVENTS}, s AS (SELECT event_type, min(day) AS a, max(day) AS b FROM ev GROUP BY 1) SELECT event_type, CAST(a + 5.0 * k AS DOUBLE) AS time FROM s, unnest(range(1, 100)) AS u(k) WHERE a + 5.0 * k <= b""",
)
def emission_schedule(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("event_type").agg(F.min("day").cast("double").alias("a"), F.max("day").cast("double").alias("b"))
    return windows.emission_times(s, "a", "b", 5.0).select("event_type", "time")


@query(
    "series_reductions",
    f"""WITH {DAILY}, w AS (SELECT *, 0.5 * (v + lead(v) OVER o) * (lead(day) OVER o - day) AS slab FROM daily WINDOW o AS (PARTITION BY event_type ORDER BY day))
    SELECT event_type, arg_max(v, day) AS final, max(v) AS max, min(v) AS min, round(avg(v), 6) AS mean, arg_min(day, (-v, day)) AS time_of_max, arg_min(day, (v, day)) AS time_of_min, round(coalesce(sum(slab), 0), 4) AS integral,
    count(*) FILTER (WHERE v > 1000) AS count_above, CAST(min(day) FILTER (WHERE v > 1000) AS DOUBLE) AS first_above, CAST(max(day) FILTER (WHERE v > 1000) AS DOUBLE) AS last_above, count(*) FILTER (WHERE v < 1000) AS count_below, CAST(min(day) FILTER (WHERE v < 1000) AS DOUBLE) AS first_below, CAST(max(day) FILTER (WHERE v < 1000) AS DOUBLE) AS last_below FROM w GROUP BY event_type""",
)
def series_reductions(spark, sf_dir):
    out = rounded(reduce.reductions(daily(spark, sf_dir), ["event_type"], "day", "v", 1000.0)).withColumn("integral", F.round("integral", 4))
    return out.withColumns({c: F.col(c).cast("double") for c in ("first_above", "last_above", "first_below", "last_below")})


@query(
    "series_reductions_by_user",
    f"""WITH {EVENTS}, d AS (SELECT user_id, day, round(sum(value), 4) AS v FROM ev GROUP BY 1, 2), w AS (SELECT *, 0.5 * (v + lead(v) OVER o) * (lead(day) OVER o - day) AS slab FROM d WINDOW o AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, arg_max(v, day) AS final, max(v) AS max, min(v) AS min, round(avg(v), 5) AS mean, arg_min(day, (-v, day)) AS time_of_max, arg_min(day, (v, day)) AS time_of_min, round(coalesce(sum(slab), 0), 3) AS integral FROM w GROUP BY user_id""",
)
def series_reductions_by_user(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", "day").agg(F.round(F.sum("value"), 4).alias("v"))
    return rounded(reduce.reductions(d, ["user_id"], "day", "v"), 5).withColumn("integral", F.round("integral", 3))


@query(
    "threshold_series",
    f"""WITH {DAILY}, m AS (SELECT *, avg(v) OVER (PARTITION BY event_type) AS thr FROM daily) SELECT event_type, count(*) FILTER (WHERE v > thr) AS count_above, min(day) FILTER (WHERE v > thr) AS first_above, max(day) FILTER (WHERE v < thr) AS last_below FROM m GROUP BY 1""",
)
def threshold_series(spark, sf_dir):
    """Crossings of a threshold that is itself a series."""
    from pyspark.sql.window import Window as W

    d = daily(spark, sf_dir).withColumn("thr", F.avg("v").over(W.partitionBy("event_type")))
    return reduce.reductions(d, ["event_type"], "day", "v", F.col("thr")).select("event_type", "count_above", "first_above", "last_below")


@query("value_at_day", f"""WITH {DAILY} SELECT event_type, CASE WHEN max(day) >= 17 THEN arg_max(v, day) FILTER (WHERE day <= 17) END AS value_at FROM daily GROUP BY 1""")
def value_at_day(spark, sf_dir):
    return reduce.value_at(daily(spark, sf_dir), ["event_type"], "day", "v", 17)


@query(
    "as_of_order_value",
    """WITH s AS (SELECT o_custkey AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), e AS (SELECT k, max(t) AS last_t FROM s GROUP BY k),
    p AS (SELECT c_custkey AS k, unnest([300, 1200, 2100]) AS t FROM customer)
    SELECT p.k AS custkey, CAST(p.t AS BIGINT) AS at, CASE WHEN p.t <= e.last_t THEN s.v END AS price FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.t >= s.t LEFT JOIN e ON e.k = p.k""",
)
def as_of_order_value(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("t"), F.col("o_totalprice").alias("price"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.explode(F.array(*[F.lit(x).cast("long") for x in (300, 1200, 2100)])).alias("at"))
    return joins.as_of(points, o, ["custkey"], "at", "t", "price")


@query(
    "nearest_snapshot",
    f"""WITH {DAILY}, p AS (SELECT DISTINCT event_type, unnest([-3, 4, 11, 40]) AS at FROM daily) SELECT p.event_type, CAST(p.at AS BIGINT) AS at, arg_min(v, (abs(day - p.at), day)) AS v FROM p JOIN daily d ON d.event_type = p.event_type GROUP BY 1, 2""",
)
def nearest_snapshot(spark, sf_dir):
    d = daily(spark, sf_dir)
    points = d.select("event_type").distinct().withColumn("at", F.explode(F.array(*[F.lit(x).cast("long") for x in (-3, 4, 11, 40)])))
    return joins.nearest(points, d, ["event_type"], "at", "day", "v")


@query(
    "tolerant_time_join",
    f"""WITH {DAILY} SELECT a.event_type, a.day, a.v AS va, b.v AS vb FROM daily a JOIN daily b ON a.event_type = b.event_type AND a.day = b.day""",
)
def tolerant_time_join(spark, sf_dir):
    d = daily(spark, sf_dir)
    a = d.select("event_type", F.col("day").cast("double").alias("time"), "day", F.col("v").alias("va"))
    b = d.select("event_type", (F.col("day") + F.lit(4e-10)).alias("time"), F.col("v").alias("vb"))
    return joins.at_same_time(a, b, ["event_type"], "time").select("event_type", "day", "va", "vb")


FORCED = "g AS (SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS t, count(*) AS n FROM orders GROUP BY 1)"


def _days(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("t")).agg(F.count("*").alias("n"))


@query(
    "forcings_on_order_days",
    f"""WITH {FORCED} SELECT t, n, round(2.0 + 0.5 * sin(2 * pi() * (t - 30) / 365.0), 6) AS seasonal, CASE WHEN t >= 1600 THEN 3.0 WHEN t >= 800 THEN 2.0 ELSE 1.0 END AS stepped,
    round(CASE WHEN t <= 100 THEN 1.0 WHEN t < 900 THEN 1.0 + (t - 100) * (4.0 / 800) WHEN t < 2000 THEN 5.0 + (t - 900) * (-3.0 / 1100) ELSE 2.0 END, 6) AS line,
    CASE WHEN t < 900 THEN 1.0 WHEN t < 2000 THEN 5.0 ELSE 2.0 END AS held, CAST([10, 20, 30, 40][CAST(least(floor((t - 7 * floor(t / 7)) * 4 / 7.0), 3) AS INTEGER) + 1] AS DOUBLE) AS cycle,
    round(0.5 * cos(2 * pi() * t / 365.0) + 0.2 * sin(2 * pi() * t / 365.0) + 0.1 * cos(4 * pi() * t / 365.0) - 0.3 * sin(4 * pi() * t / 365.0), 6) AS waves,
    CASE WHEN t - 7 * floor(t / 7) < 5 THEN 1.0 ELSE 0.0 END AS weekday, round(2.0 + 0.5 * sin(2 * pi() * (t - 14 - 30) / 365.0), 6) AS lagged FROM g""",
)
def forcings(spark, sf_dir):
    t = F.col("t")
    knots = [100, 900, 2000], [1, 5, 2]
    out = _days(spark, sf_dir).select(
        "t", "n", forcing.sinusoid(t, 2.0, 0.5, 365.0, 30.0).alias("seasonal"), forcing.piecewise(t, [800, 1600], [1, 2, 3]).alias("stepped"),
        forcing.linear(t, *knots).alias("line"), forcing.previous(t, *knots).alias("held"), forcing.periodic(t, 7.0, [10, 20, 30, 40]).alias("cycle"),
        forcing.fourier(t, 365.0, [(0.5, 0.2), (0.1, -0.3)]).alias("waves"), forcing.on_ranges(t, 7.0, [(0, 5)]).alias("weekday"), forcing.lagged(forcing.sinusoid, t, 14.0, 2.0, 0.5, 365.0, 30.0).alias("lagged"),
    )
    return rounded(out)


@query(
    "forcing_from_table",
    f"""WITH {DAILY}, k AS (SELECT event_type, CAST(day AS DOUBLE) AS x, v, lead(CAST(day AS DOUBLE)) OVER o AS x1, lead(v) OVER o AS v1, row_number() OVER o AS i FROM daily WINDOW o AS (PARTITION BY event_type ORDER BY day)),
    p AS (SELECT DISTINCT event_type, CAST(t AS DOUBLE) + 0.5 AS t FROM daily, unnest(range(0, 32)) AS u(t))
    SELECT p.event_type, p.t, round(CASE WHEN k.x IS NULL THEN f.v WHEN k.x1 IS NULL THEN k.v ELSE k.v + (p.t - k.x) * (k.v1 - k.v) / (k.x1 - k.x) END, 5) AS value FROM p ASOF LEFT JOIN k ON p.event_type = k.event_type AND p.t >= k.x LEFT JOIN k f ON f.event_type = p.event_type AND f.i = 1""",
)
def forcing_from_table(spark, sf_dir):
    d = daily(spark, sf_dir)
    knots = d.select("event_type", F.col("day").cast("double").alias("time"), F.col("v").alias("value"))
    points = d.select("event_type").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("t", F.col("t").cast("double") + 0.5)
    return rounded(forcing.join_series(points, knots, ["event_type"]).select("event_type", "t", "value"), 5)


@query("forcing_splines")
def forcing_splines(spark, sf_dir):
    """Natural, clamped and periodic splines on a day grid (checked against closed forms in the tests)."""
    t = F.col("t")
    return _days(spark, sf_dir).select(
        "t", F.round(forcing.natural_spline(t, [0, 500, 1200, 2400], [1, 4, 2, 3]), 6).alias("natural"), F.round(forcing.b_spline(t, [0, 800, 1600, 2400], 3, [1, 2, 0, 3, 1, 2]), 6).alias("clamped"),
        F.round(forcing.periodic_b_spline(t, 365.0, [1, 3, 2, 0, 1]), 6).alias("periodic"),
    )


@query(
    "calendar_functions",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT CAST(d AS VARCHAR) AS d, round(date_diff('day', DATE '1992-01-01', d) / 7.0, 6) AS weeks, round(date_diff('day', DATE '1992-01-01', d) / 365.2425, 6) AS years, CAST(CAST(d + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, CAST(CAST(d + INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS next_year, date_diff('day', DATE '1970-01-01', d) AS day_number,
    CAST(DATE '1992-01-01' + CAST(floor(date_diff('day', DATE '1992-01-01', d) / 7.0) * 7 AS INTEGER) AS VARCHAR) AS week_start, (SELECT count(*) FROM unnest(range(0, 60)) u(i) WHERE d + i * INTERVAL 1 MONTH <= DATE '1995-01-31') AS n_months FROM d""",
)
def calendar_functions(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    weeks = calendar.to_internal(F.col("d"), "1992-01-01", "weeks")
    months = F.size(calendar.date_range(F.col("d"), F.lit("1995-01-31").cast("date"), months=1))
    text = lambda c: c.cast("string")
    return d.select(
        text(F.col("d")).alias("d"), F.round(weeks, 6).alias("weeks"), F.round(calendar.to_internal(F.col("d"), "1992-01-01", "years"), 6).alias("years"), text(calendar.add_months(F.col("d"), 1)).alias("next_month"), text(calendar.add_years(F.col("d"), 1)).alias("next_year"),
        F.unix_date("d").cast("long").alias("day_number"), text(calendar.to_date(F.floor(weeks), "1992-01-01", "weeks")).alias("week_start"), months.cast("long").alias("n_months"),
    )


@query(
    "date_ranges_on_their_cadence",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), u AS (SELECT unnest(range(0, 200)) AS i),
    m AS (SELECT d, count(*) FILTER (WHERE CAST(d + i * INTERVAL 3 MONTH AS DATE) <= e) AS quarters, count(*) FILTER (WHERE CAST(d + i * INTERVAL 3 MONTH AS DATE) < e) AS before_end, max(CAST(d + i * INTERVAL 3 MONTH AS DATE)) FILTER (WHERE CAST(d + i * INTERVAL 3 MONTH AS DATE) <= e) AS last_quarter
      FROM (SELECT d, i, CAST(d + INTERVAL 9 MONTH AS DATE) AS e FROM d, u) GROUP BY d),
    w AS (SELECT d, count(*) FILTER (WHERE d + CAST(14 * i AS INTEGER) <= DATE '1996-02-29') AS fortnights, count(*) FILTER (WHERE CAST(d + i * INTERVAL 1 YEAR AS DATE) <= DATE '1996-02-29') AS years FROM d, u GROUP BY d)
    SELECT CAST(d AS VARCHAR) AS d, quarters, before_end, CAST(last_quarter AS VARCHAR) AS last_quarter, fortnights, years FROM m JOIN w USING (d)""",
)
def date_ranges_on_their_cadence(spark, sf_dir):
    """Ranges with an end on the cadence, before the start, and off the cadence."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    end, leap = F.add_months("d", 9), F.lit("1996-02-29").cast("date")
    quarters = calendar.date_range(F.col("d"), end, months=3)
    size = lambda c: F.size(c).cast("long")
    return d.select(
        F.col("d").cast("string").alias("d"), size(quarters).alias("quarters"), size(calendar.date_range(F.col("d"), end, months=3, inclusive_end=False)).alias("before_end"), F.array_max(quarters).cast("string").alias("last_quarter"),
        size(calendar.date_range(F.col("d"), leap, days=14)).alias("fortnights"), size(calendar.date_range(F.col("d"), leap, years=1)).alias("years"),
    )


@query("observation_anchors", f"""WITH {EVENTS} SELECT event_type, min(day) - 7.0 AS first_obs, max(day) + 14.0 AS last_obs FROM ev GROUP BY 1""")
def observation_anchors(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.col("day").cast("double"))
    return calendar.anchors(e, ["event_type"], "day", 7.0, 14.0)

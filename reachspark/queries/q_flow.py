"""Flow records: seasons, duration, peaks, return periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import duration, recruitment
from ..sources.lookup import RecruitmentParameters
from .registry import DISCHARGES, Data, query, rounded, sql

PEAKS = "p_v as (select year(d) * 100 + month(d) block, max(q) peak from flow_v group by 1)"


@query("years_spanned", sql("gauge_flow_v", body="select distinct gauge, cast(year(d) as int) as year from gauge_flow_v"))
def years(d: Data):
    return duration.years(d.gauges, ["gauge"])


@query("season_flows", sql("gauge_flow_v", body="select gauge, d, q from gauge_flow_v where month(d) * 100 + day(d) between 201 and 615"))
def season(d: Data):
    return duration.season_flows(d.gauges, (2, 1), (6, 15))


@query(
    "duration_curve",
    sql(
        "gauge_flow_v",
        body="""select gauge, d, q, cast(row_number() over w as int) rank, count(*) over (partition by gauge) n, round(row_number() over w / count(*) over (partition by gauge) * 100, 6) exceedance
        from gauge_flow_v where month(d) * 100 + day(d) >= 1001 or month(d) * 100 + day(d) <= 228 window w as (partition by gauge order by q desc, d)""",
    ),
)
def curve(d: Data):
    return rounded(duration.duration_curve(d.gauges, (10, 1), (2, 28), ["gauge"]))


EXCEED = """
  c_v as (select *, row_number() over (partition by {k} order by q desc) / count(*) over (partition by {k}) * 100 e from {src}),
  d_v as (select {k}, q, max(e) e from c_v group by {k}, q),
  x_v as (select {k}, dq from (select distinct {k} from d_v), (select unnest([{qs}]) dq)),
  b_v as (select x.*, (select max(q) from d_v d where {on} and d.q <= x.dq) lo, (select min(q) from d_v d where {on} and d.q >= x.dq) hi from x_v x),
  z_v as (select b.{kk}, b.dq as q, case when lo is null then 100.0 when hi is null then 0.0 when lo = hi then l.e else l.e + (b.dq - lo) * (h.e - l.e) / (hi - lo) end exceedance
    from b_v b left join d_v l on {lon} and l.q = lo left join d_v h on {hon} and h.q = hi)"""


def exceed_sql(source: str, keys: list[str], values: list[float]) -> str:
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return EXCEED.format(
        src=source, k=", ".join(keys), kk=", b.".join(keys), qs=", ".join(f"{v}::double" for v in values), on=on("d", "x"), lon=on("l", "b"), hon=on("h", "b")
    )


AT = [500.0, 1000.0, 20000.0, 45000.0, 60000.0, 200000.0]


@query("exceedance_at", sql("gauge_flow_v", ctes=exceed_sql("gauge_flow_v", ["gauge"], AT), body="select gauge, q, round(exceedance, 6) exceedance from z_v"))
def exceedance(d: Data):
    curve = duration.duration_curve(d.gauges, keys=["gauge"])
    return rounded(duration.exceedance_at(curve, d.values([(q,) for q in AT], "q double"), ["gauge"]))


SEASONS = [
    ("Chinook salmon", "fry", 2, 1, 6, 15),
    ("Chinook salmon", "adult", 10, 1, 2, 28),
    ("Pacific lamprey", "ammocoetes", None, None, None, None),
    ("Rainbow trout", "juvenile", 2, 29, 2, 29),
]
SEASON_DDL = "species string, lifestage string, start_m int, start_d int, end_m int, end_d int"
SEASON_SQL = """
  s_v as (select * from (values ('Chinook salmon', 'fry', 201, 615), ('Chinook salmon', 'adult', 1001, 228), ('Rainbow trout', 'juvenile', 229, 229)) t(species, lifestage, a, b)),
  f_v as (select species, lifestage, d, q from flow_v join s_v on case when a <= b then month(d) * 100 + day(d) between a and b else month(d) * 100 + day(d) >= a or month(d) * 100 + day(d) <= b end)"""


@query(
    "seasonal_duration",
    sql(
        "flow_v",
        ctes=SEASON_SQL + "," + exceed_sql("f_v", ["species", "lifestage"], [q for _, q, _ in DISCHARGES]),
        body="""select species, lifestage, q, round(exceedance, 6) exceedance, lower(substr(species, 1, 2)) || substr(lifestage, 1, 2) code,
          (select cast(count(*) as bigint) from f_v f where f.species = z_v.species and f.lifestage = z_v.lifestage) days_in_season from z_v""",
    ),
)
def seasonal(d: Data):
    return rounded(duration.seasonal_duration(d.flow, d.values(SEASONS, SEASON_DDL), d.discharges.select("q")))


@query(
    "annual_peaks",
    sql("gauge_flow_v", body="select gauge, cast(year(d) + case when month(d) >= 10 then 1 else 0 end as int) as year, max(q) peak from gauge_flow_v group by 1, 2"),
)
def peaks(d: Data):
    return duration.annual_peaks(d.gauges, keys=["gauge"])


@query("calendar_peaks", sql("gauge_flow_v", body="select gauge, cast(year(d) as int) as year, max(q) peak from gauge_flow_v group by 1, 2"))
def calendar_peaks(d: Data):
    return duration.annual_peaks(d.gauges, (1, 1), ["gauge"])


@query(
    "return_periods",
    sql(
        "gauge_flow_v",
        ctes="""p_v as (select gauge, year(d) * 100 + month(d) block, max(q) peak from gauge_flow_v group by 1, 2),
          f_v as (select gauge, stddev_samp(peak) * sqrt(6) / pi() s, avg(peak) - 0.5772156649015329 * stddev_samp(peak) * sqrt(6) / pi() u from p_v group by 1 having count(*) >= 10)""",
        body="""select distinct gauge, peak as q, round(greatest(1, 1 / (1 - least(exp(-exp(-(peak - u) / s)), 1 - 1e-9))), 5) period from p_v join f_v using (gauge)""",
    ),
)
def periods(d: Data):
    block = F.year("d") * 100 + F.month("d")
    maxima = d.gauges.groupBy("gauge", block.alias("block")).agg(F.max("q").alias("peak"))
    enough = maxima.groupBy("gauge").count().filter("count >= 10").select("gauge")
    return rounded(duration.return_periods(maxima.join(enough, "gauge", "left_semi"), keys=["gauge"]), 5)


@query(
    "flood_periods",
    sql(
        "flow_v",
        ctes=PEAKS + ", f_v as (select stddev_samp(peak) * sqrt(6) / pi() s, avg(peak) - 0.5772156649015329 * stddev_samp(peak) * sqrt(6) / pi() u from p_v)",
        body="select q, round(greatest(1, 1 / (1 - least(exp(-exp(-(q - u) / s)), 1 - 1e-9))), 5) period from f_v, (select distinct q from flow_v)",
    ),
)
def flood_periods(d: Data):
    maxima = d.flow.groupBy((F.year("d") * 100 + F.month("d")).alias("block")).agg(F.max("q").alias("peak"))
    return rounded(duration.return_periods(maxima, d.flow.select("q").distinct()), 5, q=9)


@query(
    "flow_brackets",
    sql(
        "flow_v",
        ctes="m_v as (select unnest([1000.0, 2000.0, 3000.0, 4000.0, 5000.0, 6000.0]) m)",
        body="""select d, q, lo q_lo, hi q_hi, round(case when hi > lo then (q - lo) / (hi - lo) else 0 end, 11) weight from (
          select d, q, cast(case when q <= 1000 then 1000 when q >= 6000 then 6000 else (select max(m) from m_v where m < q) end as double) lo,
            cast(case when q <= 1000 then 1000 when q >= 6000 then 6000 else (select min(m) from m_v where m >= q) end as double) hi from flow_v)""",
    ),
)
def brackets(d: Data):
    return rounded(recruitment.flow_brackets(d.flow, d.discharges.filter("q < 7000").select("q")), 11)


@query(
    "nearest_day_flow",
    sql(
        "gauge_flow_v",
        body="select gauge, arg_min(q, abs(date_diff('day', date '1995-09-15', d)) * 100000 + date_diff('day', date '1900-01-01', d)) q from gauge_flow_v group by 1",
    ),
)
def nearest_day(d: Data):
    gap = F.struct(F.abs(F.datediff("d", F.lit("1995-09-15").cast("date"))), F.col("d"))
    return d.gauges.groupBy("gauge").agg(F.min_by("q", gap).alias("q"))


@query(
    "window_peaks",
    sql(
        "gauge_flow_v",
        body="""select gauge, max(case when d >= date '1994-05-02' and d < date '1995-05-02' then q end) prep_peak, max(case when d > date '1995-06-20' and d <= date '1995-09-15' then q end) scour_peak,
          min(case when d between date '1995-05-02' and date '1995-06-20' then q end) seed_low, max(case when d between date '1995-05-02' and date '1995-06-20' then q end) seed_high from gauge_flow_v group by 1""",
    ),
)
def window_peaks(d: Data):
    return recruitment.window_peaks(d.gauges, 1995, RecruitmentParameters(), ["gauge"])


@query("flow_set_operations", sql("gauge_flow_v", body="select d from gauge_flow_v where q > 50000 intersect select d from gauge_flow_v where q < 1500"))
def set_operations(d: Data):
    return d.gauges.filter("q > 50000").select("d").intersect(d.gauges.filter("q < 1500").select("d"))

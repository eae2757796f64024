"""Every registered query with its reference SQL.

A query is a Spark plan, the SQL that says what it must return, and the shape
of the result. The shape lists `column:type`, with s text, i whole number,
t timestamp and d<n> decimal fraction rounded to n places; the same list casts
the Spark columns and the SQL columns, so both sides compare value by value.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.analogue import oracle
from stayline.analogue import views as V
from stayline.functions import scalars as S
from stayline.operators import crosstab as C
from stayline.operators import demographics as D
from stayline.operators import describe as N
from stayline.operators import pay as P
from stayline.operators import safety, teaming
from stayline.operators import text as X
from stayline.plans import demographics, pay_profile, survey, team_history
from stayline.sources import handover, schemas, tables


@dataclass(frozen=True)
class Query:
    plan: Callable[[V.Analogue], DataFrame]
    shape: str
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(V.Analogue(spark, folder))
        return df.selectExpr(*[_spark_column(c) for c in self.shape.split()])

    def reference(self) -> str:
        columns = ", ".join(_sql_column(c) for c in self.shape.split())
        return oracle.sql(f"SELECT {columns} FROM ({self.sql}) result")


def _spark_column(spec: str) -> str:
    name, kind = spec.split(":")
    types = {"s": "STRING", "i": "BIGINT", "t": "TIMESTAMP_NTZ"}
    if kind in types:
        return f"CAST(`{name}` AS {types[kind]}) AS `{name}`"
    return f"round(CAST(`{name}` AS DOUBLE), {kind[1:]}) AS `{name}`"


def _sql_column(spec: str) -> str:
    name, kind = spec.split(":")
    types = {"s": "VARCHAR", "i": "BIGINT", "t": "TIMESTAMP"}
    if kind in types:
        return f'CAST("{name}" AS {types[kind]}) AS "{name}"'
    return f'round(CAST("{name}" AS DOUBLE), {kind[1:]}) AS "{name}"'


QUERIES: dict[str, Query] = {}


def register(name: str, shape: str, sql: str | None):
    def keep(plan: Callable[[V.Analogue], DataFrame]):
        QUERIES[name] = Query(plan, shape, sql)
        return plan

    return keep


# --- shared inputs -----------------------------------------------------------
def _cohorts(a: V.Analogue) -> DataFrame:
    return P.select_cohorts(a.profile(), V.CUTOFF, V.AS_OF)


EARLIEST = P.earliest_period(V.CUTOFF, V.AS_OF)


def _legs(a: V.Analogue) -> DataFrame:
    return teaming.clean_legs(a.legs(), V.FIRST_DAY, V.LAST_DAY)


def _history(a: V.Analogue, mode: str = "as_written") -> DataFrame:
    return team_history.history(a.legs(), a.city(), V.FIRST_DAY, V.LAST_DAY, mode)


def _workforce(a: V.Analogue) -> pay_profile.Workforce:
    # the D in front of a co-driver's id is taken off to match the profile ids
    return a.workforce(_history(a).withColumn("DriverID", F.expr("substr(DriverID, 2)")))


# --- pay, safety and tenure --------------------------------------------------
@register(
    "cohort_select",
    "stayed:i mpp_id:s StartDate:t mpp_terminationdt:t mpp_state:s mpp_type2:s mpp_type1:s Drivertype:s",
    "SELECT * FROM cohort",
)
def cohort_select(a):
    return _cohorts(a)


@register(
    "pay_interval_join",
    "stayed:i mpp_id:s pyh_payperiod:t pyt_itemcode:s pyd_amount:d4 mpp_terminationdt:t StartDate:t",
    "SELECT * FROM paid",
)
def pay_interval_join(a):
    return P.in_window(a.pay_lines(EARLIEST), _cohorts(a), EARLIEST)


_BUCKETS = " ".join(f"{b}:d4" for b in K.BUCKET_NAMES) + " count:i latehome:i layover:i"
_WEEK_KEYS = "stayed:i mpp_id:s pyh_payperiod:t mpp_terminationdt:t StartDate:t mpp_state:s mpp_type1:s Drivertype:s"


@register("pay_code_buckets", f"{_WEEK_KEYS} {_BUCKETS}", "SELECT * FROM code_rows")
def pay_code_buckets(a):
    return P.pay_code_buckets(a.pay_lines(EARLIEST), _cohorts(a), EARLIEST)


@register(
    "pay_code_buckets_intended",
    f"{_WEEK_KEYS} {_BUCKETS}",
    "SELECT * FROM code_sums",
)
def pay_code_buckets_intended(a):
    return P.pay_code_buckets(a.pay_lines(EARLIEST), _cohorts(a), EARLIEST, mode="as_intended")


_FACTS = " ".join(f"{f}:i" for f in P.WEEK_FACTS)


@register(
    "weekly_rollup",
    f"stayed:i mpp_id:s Drivertype:s mpp_type1:s pyh_payperiod:t weekpay:d4 {_FACTS} ranking:i",
    "SELECT * FROM weeks",
)
def weekly_rollup(a):
    return P.weekly_rollup(P.code_rows(a.pay_lines(EARLIEST), _cohorts(a), EARLIEST))


_TOTALS = " ".join(f"{name}:d2" for name, _ in K.DRIVER_TOTALS)
_STATS = f"stayed:i mpp_id:s Drivertype:s mpp_type1:s {_TOTALS} termedbinary:i mindridiff:d2 maxdridiff:d2 avgdriverpay:d6 groupavgpay:d6"


@register("driver_pay_stats", _STATS, "SELECT * FROM totals")
def driver_pay_stats(a):
    return P.with_group_pay(pay_profile.driver_stats(a.pay_side()))


@register("driver_pay_stats_intended", _STATS, "SELECT * FROM totals_each")
def driver_pay_stats_intended(a):
    return P.with_group_pay(pay_profile.driver_stats(a.pay_side(), pay_profile.Modes(dedupe="as_intended")))


_MODEL = " ".join(f"{name}:d2" for name, _ in K.DRIVER_TOTALS) + " avgdriverpay:d6 groupavgpay:d6"


@register(
    "cohort_union",
    f"stayed:i mpp_id:s Drivertype:s mpp_type1:s DriverName:s {_MODEL}",
    "SELECT * FROM company",
)
def cohort_union(a):
    return pay_profile.model(a.pay_side())


_STAR = f"stayed:i mpp_id:s Drivertype:s DriverName:s phone:s {_MODEL} Critical:i seniority:i daystoacc:i CSA:d4 Violations:i"


@register("safety_star", _STAR, "SELECT * FROM record")
def safety_star(a):
    return pay_profile.safety_profile(a.workforce(None))


def _beyond_bigint(shape: str) -> str:
    """The multiplied counts may be larger than a whole number column holds."""
    return " ".join(c.replace(":i", ":d0") if c in ("Critical:i", "Violations:i") else c for c in shape.split())


@register("safety_star_as_written", _beyond_bigint(_STAR), "SELECT * FROM record_as_written")
def safety_star_as_written(a):
    return pay_profile.safety_profile(a.workforce(None), pay_profile.Modes(fanout="as_written"))


@register(
    "violations_by_person",
    "mpp_id:s vio_rows:i vio_sum:d4",
    """SELECT mpp_id, count(*) AS vio_rows, sum(CAST(ViolationValue AS DOUBLE)) AS vio_sum
FROM v_profile p JOIN v_violations v
  ON COALESCE(p.mpp_firstname || ' ' || p.mpp_lastname, 'UNKNOWN') = v.DriverName
GROUP BY mpp_id""",
)
def violations_by_person(a):
    found = safety.violations_by_person(a.names(), a.violations())
    return found.withColumnRenamed("v_id", "mpp_id")


@register(
    "tenure_bands",
    "seniority:s people:i newest:t",
    f"""SELECT {oracle.bands("m", K.PROFILE_TENURE, K.PROFILE_TENURE_ABOVE, "'UNKNOWN'")} AS seniority,
       count(*) AS people, max(mpp_hiredate) AS newest
FROM (SELECT mpp_hiredate, date_diff('month', mpp_hiredate, {oracle.AS_OF}) AS m FROM v_profile) x GROUP BY 1""",
)
def tenure_bands(a):
    months = S.month_boundaries(F.col("mpp_hiredate"), S.ntz(V.AS_OF))
    return (
        a.profile()
        .groupBy(S.profile_tenure(months).alias("seniority"))
        .agg(F.count(F.lit(1)).alias("people"), F.max("mpp_hiredate").alias("newest"))
    )


_PEOPLE = (
    "mpp_id:s stayed:i Drivertype:s DriverName:s phone:s seniority:s Critical:i daystoacc:i CSA_month:d6 Vio_month:d6 "
    "numteams:i partsolo:d2 avgtenure:d6 stdevtenure:d6 maxrank:i"
)


@register("team_statistics", _PEOPLE, "SELECT * FROM people")
def team_statistics(a):
    return pay_profile.people(_workforce(a))


@register("team_statistics_as_written", _beyond_bigint(_PEOPLE), "SELECT * FROM people_as_written")
def team_statistics_as_written(a):
    return pay_profile.people(_workforce(a), pay_profile.Modes(fanout="as_written"))


@register("team_statistics_stored", _PEOPLE, "SELECT * FROM people")
def team_statistics_stored(a):
    """The co-driver history handed over as the table that the other workload stored."""
    path = handover.of_session(a.spark).path("teaming")
    tables.create_parquet(_history(a).withColumn("DriverID", F.expr("substr(DriverID, 2)")), path)
    return pay_profile.people(a.workforce(tables.read_parquet(a.spark, path)))


_SUMMARY = (
    "stayed:i Drivertype:s seniority:s Critical:d6 endorse:d6 chargeback:d6 safety:d6 correction:d6 latehome:d6 "
    "layover:d6 paydetails:d6 avgpay:d6 count:i CSA:d6 Vio:d6 numteams:d6 solo:d6 avgtenure:d6 stdevtenure:d6"
)


_MEANS_OF = {
    "endorse": "endorsecount", "chargeback": "chargebackcount", "safety": "safetycount", "correction": "correctioncount",
    "latehome": "latehomecount", "layover": "layoverbinary", "paydetails": "paydetails", "avgpay": "groupavgpay",
    "CSA": "CSA_month", "solo": "numteams - partsolo", "stdevtenure": "stdevtenure",
}
_WHOLE_MEANS_OF = {"Critical": "Critical", "Vio": "Vio_month", "numteams": "numteams", "avgtenure": "avgtenure"}


def _summary_sql(source: str) -> str:
    means = [f"avg({expr}) AS {name}" for name, expr in _MEANS_OF.items()]
    means += [f"sum({c}) // nullif(count({c}), 0) AS {name}" for name, c in _WHOLE_MEANS_OF.items()]
    return f'SELECT stayed, Drivertype, seniority, count(*) AS "count", {", ".join(means)} FROM {source} GROUP BY ALL'


@register(
    "cohort_summary",
    f"order:i {_SUMMARY}",
    f"""SELECT *, row_number() OVER (ORDER BY Drivertype, seniority, stayed) AS "order" FROM ({_summary_sql("people")}) s""",
)
def cohort_summary(a):
    return teaming.numbered_summary(pay_profile.people(_workforce(a)))


@register("cohort_summary_as_written", _beyond_bigint(_SUMMARY), _summary_sql("people_as_written"))
def cohort_summary_as_written(a):
    return pay_profile.summary(_workforce(a), pay_profile.Modes(fanout="as_written"))


_PROFILE = {
    "FINESavg": "finescount", "DETavg": "detentioncount", "DRVSLYavg": "DRVSLYcount", "endorseavg": "endorsecount",
    "chargebackavg": "chargebackcount", "safetyavg": "safetycount", "correctionavg": "correctioncount",
    "payavg": "paydetails", "mindriavg": "mindridiff", "maxdiravg": "maxdridiff", "avgdripayavg": "avgdriverpay",
    "groupavgpayavg": "groupavgpay",
}


@register(
    "group_profile",
    "stayed:i Drivertype:s mpp_type1:s " + " ".join(f"{n}:d6" for n in _PROFILE),
    "SELECT stayed, Drivertype, mpp_type1, "
    + ", ".join(f"avg({c}) AS {n}" for n, c in _PROFILE.items())
    + " FROM totals GROUP BY ALL",
)
def group_profile(a):
    return P.group_profile(pay_profile.driver_stats(a.pay_side()))


@register(
    "expiry_list",
    "mpp_id:s stayed:i Drivertype:s DriverName:s phone:s seniority:s Critical:i numteams:i DriverID:s",
    "SELECT * FROM people JOIN v_expirations ON mpp_id = DriverID",
)
def expiry_list(a):
    return pay_profile.expiring(_workforce(a), a.expirations())


_LIST = ["mpp_id", "DriverName", "phone", "DriverID"]
_SUMMARY_COLUMNS = [c.split(":")[0] for c in _SUMMARY.split()]
_BOTH = f"result:s {_SUMMARY} " + " ".join(f"{c}:s" for c in _LIST)
_LISTED = [c if c in ("stayed", "Drivertype", "seniority", "Critical", "numteams") else None for c in _SUMMARY_COLUMNS]


@register(
    "summary_and_list",
    _BOTH,
    f"""SELECT 'summary' AS result, {", ".join(f'"{c}"' for c in _SUMMARY_COLUMNS)}, {", ".join(f"NULL AS {c}" for c in _LIST)} FROM ({_summary_sql("people")}) s
UNION ALL SELECT 'list', {", ".join(c or "NULL" for c in _LISTED)}, {", ".join(_LIST)} FROM people JOIN v_expirations ON mpp_id = DriverID""",
)
def summary_and_list(a):
    """Both results of a run, in one table, of person rows that are made once."""
    summary, listed = pay_profile.results(_workforce(a), a.expirations(), handover.of_session(a.spark))
    one = summary.select(F.lit("summary").alias("result"), *_SUMMARY_COLUMNS)
    return one.unionByName(listed.select(F.lit("list").alias("result"), *filter(None, _LISTED), *_LIST), allowMissingColumns=True)


# --- co-drivers --------------------------------------------------------------
_LEG = "ord_hdrnumber:s lgh_number:s lgh_driver1:s lgh_driver2:s"


@register(
    "leg_clean",
    f"{_LEG} lgh_startdate:t lgh_enddate:t lgh_class1:s trc_division:s lgh_startcity:s lgh_endcity:s",
    "SELECT * FROM clean",
)
def leg_clean(a):
    return _legs(a)


@register(
    "leg_utc_shift",
    f"{_LEG} lgh_startdateGMT:t lgh_enddateGMT:t lgh_startdateEST:t lgh_enddateEST:t lgh_hours:d6 lgh_class1:s",
    "SELECT *, date_diff('second', lgh_startdateGMT, lgh_enddateGMT) / 3600.0 AS lgh_hours FROM shifted",
)
def leg_utc_shift(a):
    return teaming.shift_legs(_legs(a), a.city())


@register(
    "pair_leg_count",
    f"{_LEG} lgh_startdateEST:t lgh_enddateEST:t leg_count:i",
    "SELECT * FROM counted",
)
def pair_leg_count(a):
    return teaming.with_leg_count(teaming.shift_legs(_legs(a), a.city()))


@register(
    "pair_totals",
    "lgh_driver1:s lgh_driver2:s leg_count:i",
    "SELECT lgh_driver1, lgh_driver2, count(*) AS leg_count FROM clean GROUP BY 1, 2",
)
def pair_totals(a):
    return teaming.pair_counts(_legs(a))


_TEAMS = "DriverID:s team_binary:d1 leg_count:i lgh_enddateEST:t"


@register("team_first_leg", _TEAMS, "SELECT * FROM teaming_legs")
def team_first_leg(a):
    return _history(a)


@register("team_first_leg_intended", _TEAMS, "SELECT * FROM teaming_legs_intended")
def team_first_leg_intended(a):
    return _history(a, mode="as_intended")


@register(
    "team_first_and_last_leg",
    "lgh_driver1:s lgh_driver2:s which:s leg_count:i lgh_startdateEST:t lgh_enddateEST:t",
    """SELECT *, CASE WHEN rn = 1 THEN 'first' ELSE 'last' END AS which FROM ranked WHERE rn = 1 OR rn = n""",
)
def team_first_and_last_leg(a):
    on_clock = teaming.shift_legs(_legs(a), a.city())
    return teaming.pair_legs(on_clock, keep_last=True)


@register("teaming_sink", _TEAMS, "SELECT * FROM teaming_legs")
def teaming_sink(a):
    """Written to the shared folder and read back."""
    path = handover.of_session(a.spark).path("teaming")
    tables.create_parquet(_history(a), path)
    return tables.read_parquet(a.spark, path)


@register("teaming_append", _TEAMS, "SELECT * FROM teaming_legs UNION ALL SELECT * FROM teaming_legs")
def teaming_append(a):
    """Written twice to the shared folder, the second time appended, and read back."""
    path = handover.of_session(a.spark).path("teaming")
    for _ in range(2):
        tables.append_parquet(_history(a), path)
    return tables.read_parquet(a.spark, path)


_RUNS = """SELECT *, run_key FROM teaming_legs, (VALUES ('one'), ('two')) v(run_key)"""


@register("teaming_append_runs", f"{_TEAMS} run_key:s", _RUNS)
def teaming_append_runs(a):
    """Two runs appended, the first of them twice: its rows are there once, the other run's stay."""
    path, rows = handover.of_session(a.spark).path("teaming"), _history(a)
    for run in ("one", "two", "one"):
        tables.append_run(rows, path, run)
    return tables.read_runs(a.spark, path, rows.schema)


# --- personal characteristics ------------------------------------------------
def _people(a: V.Analogue) -> DataFrame:
    return demographics.people(a.retention(), a.hr(), a.dependents())


def _hr_people(a: V.Analogue) -> DataFrame:
    """Labels only, for tables that read no measure."""
    return demographics.people(a.cohort_labels(), a.hr(), a.dependents())


@register(
    "dependents_per_key",
    "mpp_id:s GENDER:i ETHNORGN:i MARITALSTATUS:i DEPENDENTSSN:i",
    """SELECT h.EMPLOYID AS mpp_id, GENDER, ETHNORGN, MARITALSTATUS, n AS DEPENDENTSSN
FROM v_hr h LEFT JOIN dependents_count d ON h.EMPLOYID = d.EMPLOYID""",
)
def dependents_per_key(a):
    return D.hr_people(a.hr(), a.dependents())


@register(
    "demographic_labels",
    "mpp_id:s stayed:s GENDER:s MARITALSTATUS:s ETHNORGN:s DEPENDENTSSN:s dayshome:d6",
    "SELECT * FROM labelled",
)
def demographic_labels(a):
    return _people(a)


@register(
    "demographics_from_csv",
    "mpp_id:s stayed:s GENDER:s MARITALSTATUS:s ETHNORGN:s DEPENDENTSSN:s dayshome:d6",
    "SELECT * FROM labelled",
)
def demographics_from_csv(a):
    """The workload from CSV files that hold more columns, in another order, than it declares."""

    def stored(df: DataFrame, schema) -> DataFrame:
        path = handover.of_session(a.spark).path("csv")
        tables.write_csv(df.select(F.lit("x").alias("Region"), *reversed(df.columns), F.lit(1).alias("Rank")), path)
        return tables.read_csv(a.spark, path, schema)

    retention = a.retention().withColumns({c: F.lit(0.0) for c in K.RETENTION_DROPPED if c != "phone"}).withColumn("phone", F.lit("5"))
    return demographics.people(stored(retention, schemas.RETENTION), stored(a.hr(), schemas.HR), stored(a.dependents(), schemas.DEPENDENTS))


_CHARACTERISTICS = ["GENDER", "MARITALSTATUS", "ETHNORGN"]


def _margins_sql(column: str) -> str:
    return f"""SELECT '{column}' AS characteristic, COALESCE(stayed, 'All') AS stayed, COALESCE({column}, 'All') AS label,
       count(*) AS n FROM labelled GROUP BY CUBE (stayed, {column})"""


def _by_characteristic(a: V.Analogue, with_share: bool) -> DataFrame:
    table = C.crosstab_each(_hr_people(a), "stayed", _CHARACTERISTICS)
    return C.with_share(table, "stayed", ["characteristic", "label"]) if with_share else table


@register(
    "crosstab_margins",
    "characteristic:s stayed:s label:s n:i",
    " UNION ALL ".join(_margins_sql(c) for c in _CHARACTERISTICS),
)
def crosstab_margins(a):
    return _by_characteristic(a, with_share=False)


@register(
    "crosstab_share",
    "characteristic:s stayed:s label:s n:i share:d9",
    f"""SELECT *, n::DOUBLE / max(CASE WHEN stayed = 'All' THEN n END) OVER (PARTITION BY characteristic, label) AS share
FROM ({" UNION ALL ".join(_margins_sql(c) for c in _CHARACTERISTICS)}) t""",
)
def crosstab_share(a):
    return _by_characteristic(a, with_share=True)


@register(
    "crosstab_two_keys",
    "stayed:s MARITALSTATUS:s DEPENDENTSSN:s n:i share:d9",
    """SELECT *, n::DOUBLE / max(CASE WHEN stayed = 'All' THEN n END) OVER (PARTITION BY MARITALSTATUS, DEPENDENTSSN) AS share
FROM (SELECT COALESCE(stayed, 'All') AS stayed, COALESCE(MARITALSTATUS, 'All') AS MARITALSTATUS,
             COALESCE(DEPENDENTSSN, '') AS DEPENDENTSSN, count(*) AS n
      FROM labelled
      GROUP BY GROUPING SETS ((stayed, MARITALSTATUS, DEPENDENTSSN), (stayed), (MARITALSTATUS, DEPENDENTSSN), ())) t""",
)
def crosstab_two_keys(a):
    return demographics.by_family(_hr_people(a))


@register(
    "crosstab_wide",
    "stayed:s MALE:i FEMALE:i UNKNOWN:i All:i",
    """SELECT COALESCE(stayed, 'All') AS stayed, count(*) FILTER (GENDER = 'MALE') AS MALE,
       count(*) FILTER (GENDER = 'FEMALE') AS FEMALE, count(*) FILTER (GENDER = 'UNKNOWN') AS UNKNOWN, count(*) AS "All"
FROM labelled GROUP BY ROLLUP (stayed)""",
)
def crosstab_wide(a):
    table = C.crosstab(_hr_people(a), "stayed", "GENDER")
    return C.wide(table, "stayed", "GENDER", ["MALE", "FEMALE", "UNKNOWN", C.ALL])


@register("crosstab_margin_names", "stayed:s label:s n:i all_stayed:i all_labels:i", """
SELECT CASE WHEN grouping(stayed) = 1 THEN 'All' ELSE stayed END AS stayed, CASE WHEN grouping(label) = 1 THEN 'All' ELSE label END AS label,
       count(*) AS n, grouping(stayed) AS all_stayed, grouping(label) AS all_labels
FROM (SELECT stayed, CASE GENDER WHEN 'MALE' THEN 'All' WHEN 'FEMALE' THEN '' ELSE GENDER END AS label FROM labelled) t
GROUP BY CUBE (stayed, label)""")
def crosstab_margin_names(a):
    """Labels that read like a margin stay cells of their own."""
    renamed = F.expr("CASE GENDER WHEN 'MALE' THEN 'All' WHEN 'FEMALE' THEN '' ELSE GENDER END")
    table = C.crosstab(_hr_people(a).withColumn("label", renamed), "stayed", "label", keep_levels=True)
    return table.withColumnsRenamed({C.ROW_TOTAL: "all_stayed", C.COLUMN_TOTAL: "all_labels"})


_MEASURES = ["active_driving_day_per", "dayshome", "active_driving_day_count"]
_MEANS = "stayed:s DEPENDENTSSN:s MARRIED:d8 SINGLE:d8 UNKNOWN:d8"


def _family_sql(value: str) -> str:
    return f"""SELECT stayed, DEPENDENTSSN, avg({value}) FILTER (MARITALSTATUS = 'MARRIED') AS MARRIED,
       avg({value}) FILTER (MARITALSTATUS = 'SINGLE') AS SINGLE, avg({value}) FILTER (MARITALSTATUS = 'UNKNOWN') AS UNKNOWN
FROM labelled GROUP BY 1, 2"""


@register("pivot_means", _MEANS, _family_sql("active_driving_day_per"))
def pivot_means(a):
    return demographics.family_means(_people(a), "active_driving_day_per")


@register("pivot_means_home", _MEANS, _family_sql("dayshome"))
def pivot_means_home(a):
    return demographics.family_means(_people(a), "dayshome")


@register("pivot_means_days", _MEANS, _family_sql("active_driving_day_count"))
def pivot_means_days(a):
    return demographics.family_means(_people(a), "active_driving_day_count")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESCRIBED = "count:i mean:d6 std:d6 min:d6 p25:d6 p50:d6 p75:d6 max:d6"


def _describe_sql(column: str, source: str, by: str = "") -> str:
    return f"""SELECT {by + "," if by else ""} '{column}' AS "column", count({column}) AS "count", avg({column}) AS mean,
       stddev_samp({column}) AS std, min({column}) AS min, quantile_cont({column}, 0.25) AS p25,
       quantile_cont({column}, 0.5) AS p50, quantile_cont({column}, 0.75) AS p75, max({column}) AS max
FROM {source} {"GROUP BY " + by if by else ""}"""


@register(
    "describe_numeric",
    f"column:s {_DESCRIBED}",
    " UNION ALL ".join(_describe_sql(c, "lineitem") for c in _NUMBERS),
)
def describe_numeric(a):
    return N.describe(a.table("lineitem"), _NUMBERS)


@register(
    "describe_by_cohort",
    f"stayed:i column:s {_DESCRIBED}",
    " UNION ALL ".join(_describe_sql(c, "v_retention", "stayed") for c in _MEASURES),
)
def describe_by_cohort(a):
    return N.describe(a.retention(), _MEASURES, by=["stayed"])


@register(
    "grouped_means",
    "stayed:i " + " ".join(f"{c}:d8" for c in _MEASURES),
    "SELECT stayed, " + ", ".join(f"avg({c}) AS {c}" for c in _MEASURES) + " FROM v_retention GROUP BY stayed",
)
def grouped_means(a):
    return N.grouped_means(a.retention(), "stayed", _MEASURES)


@register(
    "cohort_split",
    "mpp_id:s stayed:s GENDER:s DEPENDENTSSN:s",
    "SELECT * FROM labelled WHERE stayed = 'Left'",
)
def cohort_split(a):
    return demographics.cohort(_hr_people(a), "Left")


@register(
    "corr_matrix",
    "x:s y:s r:d9",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r FROM lineitem" for x in _NUMBERS for y in _NUMBERS
    ),
)
def corr_matrix(a):
    return N.correlations(a.table("lineitem"), _NUMBERS)


_MANY = [f"m{i}" for i in range(25)]


def _many(i: int) -> str:
    """SQL of the i-th of many measures of a line; the fifth of each five has gaps."""
    a, b = _NUMBERS[i % 4], _NUMBERS[(i // 4 + 1) % 4]
    mixed = f"({a} * {i + 1} + {b} * ((l_partkey + {i}) % 7))"
    return f"CASE WHEN (l_orderkey + {i}) % 3 > 0 THEN {mixed} END" if i % 5 == 4 else mixed


@register(
    "corr_matrix_many",
    "x:s y:s r:d9",
    f"""SELECT unnest([{", ".join(f"{{'x': '{x}', 'y': '{y}', 'r': corr({x}, {y})}}" for x in _MANY for y in _MANY)}], recursive := true)
FROM (SELECT {", ".join(f"CAST({_many(i)} AS DOUBLE) AS {m}" for i, m in enumerate(_MANY))} FROM lineitem) l""",
)
def corr_matrix_many(a):
    """More columns than are worth an expression per pair."""
    return N.correlations(a.table("lineitem").selectExpr(*[f"{_many(i)} AS {m}" for i, m in enumerate(_MANY)]))


def _histogram_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", bin, lo + (bin - 1) * ((hi - lo) / 10.0::DOUBLE) AS "from",
       lo + bin * ((hi - lo) / 10.0::DOUBLE) AS "to", count(*) AS n
FROM (SELECT lo, hi, least(CAST(floor(10.0::DOUBLE * (x - lo) / (hi - lo) + 1) AS BIGINT), 10) AS bin
      FROM (SELECT {c} AS x, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM lineitem WHERE {c} IS NOT NULL) v) b
GROUP BY lo, hi, bin"""


@register(
    "histogram_bins",
    "column:s bin:i from:d6 to:d6 n:i",
    " UNION ALL ".join(_histogram_sql(c) for c in _NUMBERS),
)
def histogram_bins(a):
    return N.histogram(a.table("lineitem"), _NUMBERS)


@register("distinct_values", "DEPENDENTSSN:s", "SELECT DISTINCT DEPENDENTSSN FROM labelled")
def distinct_values(a):
    return C.distinct_values(_hr_people(a), "DEPENDENTSSN")


@register(
    "preview",
    "mpp_id:s mpp_type1:s mpp_type2:s mpp_hiredate:t",
    "SELECT * FROM v_profile ORDER BY mpp_hiredate NULLS FIRST, mpp_id LIMIT 30",
)
def preview(a):
    return tables.preview(a.profile(), 30, ["mpp_hiredate", "mpp_id"])


# --- survey words ------------------------------------------------------------
def _answers(a: V.Analogue, question: str) -> DataFrame:
    return survey.popular_words(a.survey(), question, a.stop_words(), V.DOMAIN_WORDS)


def _reasons(a: V.Analogue) -> DataFrame:
    return survey.reason_counts(a.survey(), a.stop_words(), V.DOMAIN_WORDS, V.THEMES)


@register(
    "term_frequency",
    "order:i word:s n:i",
    """SELECT *, row_number() OVER (ORDER BY n DESC, word) AS "order"
FROM (SELECT word, count(*) AS n FROM words_whyleft WHERE word NOT IN (SELECT word FROM v_stop_words) GROUP BY word) c""",
)
def term_frequency(a):
    return X.numbered_by_frequency(X.term_counts(a.survey(), survey.WHY_LEFT, a.stop_words()))


@register(
    "term_frequency_liked",
    "word:s n:i",
    "SELECT word, count(*) AS n FROM kept_whatsgood GROUP BY word",
)
def term_frequency_liked(a):
    return _answers(a, survey.WHATS_GOOD)


@register(
    "word_boundaries",
    "lang:s word:s n:i",
    f"""SELECT lang, word, count(*) AS n
FROM (SELECT lang, unnest(regexp_extract_all(lower(text), $${oracle.UNICODE_WORD}$$)) AS word FROM v_texts) w GROUP BY lang, word""",
)
def word_boundaries(a):
    return X.word_counts(X.explode_words(a.texts(), "text", S.unicode_words), "lang")


@register(
    "frequent_terms",
    "order:i word:s n:i",
    """SELECT *, row_number() OVER (ORDER BY n, word) AS "order"
FROM (SELECT word, count(*) AS n FROM kept_whyleft GROUP BY word HAVING count(*) > 10) c""",
)
def frequent_terms(a):
    return X.numbered_by_frequency(X.frequent_terms(_answers(a, survey.WHY_LEFT)), rarest_first=True)


@register(
    "top_terms",
    "word:s n:i",
    """SELECT word, count(*) AS n FROM themed WHERE word NOT IN (SELECT word FROM v_stop_words)
GROUP BY word HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 50""",
)
def top_terms(a):
    return survey.cloud_words(_reasons(a), a.stop_words())


@register(
    "top_terms_liked",
    "word:s n:i",
    "SELECT word, count(*) AS n FROM kept_whatsgood GROUP BY word HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 50",
)
def top_terms_liked(a):
    return survey.cloud_words(_answers(a, survey.WHATS_GOOD), a.stop_words())


@register(
    "top_terms_tracked",
    "word:s n:i",
    "SELECT word, count(*) AS n FROM kept_whatsgood GROUP BY word HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 50",
)
def top_terms_tracked(a):
    """The same cloud, of a vocabulary too large to be counted."""
    return survey.cloud_words_of(a.survey(), survey.WHATS_GOOD, a.stop_words(), V.DOMAIN_WORDS)


def _survey_band(c: str) -> str:
    return oracle.bands(c, K.SURVEY_TENURE, K.SURVEY_TENURE_ABOVE, "NULL")


@register(
    "theme_recode",
    "word:s seniority:s CVENtime:s n:i",
    f"""SELECT word, {_survey_band("seniority")} AS seniority, {_survey_band("CVENtime")} AS CVENtime, count(*) AS n
FROM themed GROUP BY 1, 2, 3""",
)
def theme_recode(a):
    return survey.themed_counts(a.survey(), a.stop_words(), V.DOMAIN_WORDS, V.THEMES)


@register(
    "sentiment_matrix",
    "word:s negative:i positive:i",
    """SELECT word, COALESCE(sum(n) FILTER (sentiment = 'negative'), 0) AS negative,
       COALESCE(sum(n) FILTER (sentiment = 'positive'), 0) AS positive FROM felt GROUP BY word""",
)
def sentiment_matrix(a):
    return X.sentiment_matrix(survey.sentiment(_reasons(a), a.lexicon()))


@register(
    "comparative_terms",
    "word:s sentiment:s excess:d9",
    """SELECT word, CASE WHEN neg >= pos THEN 'negative' ELSE 'positive' END AS sentiment,
       greatest(neg, pos) - (neg + pos) / 2 AS excess
FROM (SELECT word, COALESCE(sum(n) FILTER (sentiment = 'negative'), 0)::DOUBLE / any_value(neg_all) AS neg,
             COALESCE(sum(n) FILTER (sentiment = 'positive'), 0)::DOUBLE / any_value(pos_all) AS pos
      FROM (SELECT *, sum(n) FILTER (sentiment = 'negative') OVER () AS neg_all,
                   sum(n) FILTER (sentiment = 'positive') OVER () AS pos_all FROM felt) f
      GROUP BY word) s
ORDER BY excess DESC, word LIMIT 100""",
)
def comparative_terms(a):
    return X.comparative_terms(survey.sentiment(_reasons(a), a.lexicon()))

"""Workforce input tables derived from the generated star-schema tables.

The generated tables know nothing about employment, so the meaning is made up;
the views only give every operator whole tables of the right shape to run on.
All view columns are expressions over scan columns, so column pruning and the
conditions that can be pushed still reach the Parquet scans.
"""

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayline import constants as K
from stayline.functions import scalars as S
from stayline.operators.pay import earliest_period
from stayline.plans.pay_profile import Workforce
from stayline.sources import schemas
from stayline.sources.tables import small_table

AS_OF = datetime(2000, 6, 15)
CUTOFF = date(1998, 1, 1)
FIRST_DAY = date(1995, 6, 1)
LAST_DAY = date(2000, 6, 30)

# a code of each class and bucket, by their place in the lists; others and missing ones too
CLASS_CODES = [K.DRIVER_CLASSES[c][i] for c, i in (("Team Driver_Student", 2), ("Owner Operator", 0), ("DRVENG", 1), ("Trainer", 1), ("OTR", 0))]
CLASS_CODES += [None, K.DRIVER_CLASSES["Team Driver_Student"][8]]
PAY_CODES = [*K.UNCOUNTED_CODES[::-1], "LDMNY", "FINES", "DETPAY", *(K.PAY_BUCKETS["chargeback"][i] for i in (1, 3, 0, 7, 8))]
PAY_CODES += ["DRVSLY", "ENDRSE", "BNSSAF", "HAZRET", "GRNT", K.LATE_HOME_CODE, K.LAYOVER_CODE, "MISC", "ADV.PA", None]
STOP_WORDS = ["the", "of", "and", "to", "a", "in", "de", "la"]
DOMAIN_WORDS = ["is", "that", "it", "for", "der", "die", "th"]
THEMES = {
    "familyneeds": ["was", "on", "with", "be"],
    "teamissues": ["by", "as", "this"],
    "expectations": ["are", "at", "from", "er", "an"],
    "communication": ["nd", "ha"],
    "training": ["re", "rewh"],
}
LEXICON = [
    ("he", "positive"), ("es", "negative"), ("orre", "positive"), ("en", "negative"),
    ("thatin", "negative"), ("ononst", "positive"), ("inoran", "positive"), ("ed", "negative"),
    ("hehely", "positive"), ("ing", "negative"), ("ti", "positive"), ("ti", "negative"),
    ("or", "negative"), ("was", "positive"), ("ea", "positive"), ("nt", "negative"),
    ("training", "positive"), ("unheardof", "negative"),
]


HARD_WORDS = [
    "L·l can’t o’’clock rock’n’roll 3.5 1,000 1;2 a.5 5.a x_y a:b 1:2 e.g. .a. b’ ’c", "日本語テスト ガッコー 漢字かな 한국어 ไทย word中文2",
    "cafe\u0301 e\u0301’e\u0301 co\u00adop \U0001f600 \U0001f468\u200d\U0001f469\u200d\U0001f467 naïve…x \U0001f1eb\U0001f1f7", "١٢٫٣ 1٬000 ½ x² Ⅳ a1b2.c3 3.14.15 v1.2b", "ÀÉÎ ß straße ÑANDÚ l’été d’accord",
]

_SCHEMAS: dict[str, StructType] = {}


def pick(number: str, values) -> str:
    """SQL that takes one of the values by the remainder of a number."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {number} % {len(values)} {arms} END"


def spelt(code: str, number: str) -> str:
    """SQL that writes a code in one of three spellings, by the remainder of a number: as it is, small, small and padded."""
    return f"concat(if({number} % 3 = 0, {code}, lower({code})), if({number} % 3 = 2, '  ', ''))"


def code(text: str) -> str:
    return f"collate({text}, '{schemas.COLLATION}')"


def moment(day: date | datetime) -> str:
    return f"TIMESTAMP_NTZ'{day:%Y-%m-%d %H:%M:%S}'"


class Analogue:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A generated table; its file schema is looked up once per process."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # --- people --------------------------------------------------------------
    def profile(self) -> DataFrame:
        def days_after(first: date, days: str) -> str:
            return f"CAST(date_add(DATE'{first}', CAST({days} AS INT)) AS TIMESTAMP_NTZ)"

        return self.table("customer").selectExpr(
            "CAST(c_custkey AS STRING) AS mpp_id",
            f"CASE WHEN c_custkey % 3 = 0 THEN {days_after(CUTOFF, 'c_custkey % 365 - 60')} "
            f"ELSE {moment(K.ACTIVE_UNTIL)} END AS mpp_terminationdt",
            "concat('S', c_nationkey) AS mpp_state",
            f"""{code(spelt("CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_nationkey % 5 = 0 THEN 'Lease' ELSE 'Company' END", "(c_custkey DIV 4)"))} AS mpp_type1""",
            f"{code(spelt(pick('c_custkey', CLASS_CODES), '(c_custkey DIV 5)'))} AS mpp_type2",
            f"""{code(spelt("CASE WHEN c_custkey % 3 = 0 THEN 'OUT' ELSE 'ACT' END", "(c_custkey DIV 6)"))} AS mpp_status""",
            "CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS mpp_firstname",
            "c_name AS mpp_lastname",
            "concat('555-', c_custkey) AS mpp_currentphone",
            f"CASE WHEN c_custkey % 43 <> 0 THEN {days_after(date(1995, 1, 1), 'c_custkey * 7 % 2000')} END AS mpp_hiredate",
        )

    def pay_lines(self, since: date | None = None) -> DataFrame:
        """Order lines as pay lines of the ordering customer.

        A period is the Monday on or before the order day, so pay since a day
        can only come from orders since that day; the order scan gets that
        condition.
        """
        orders = self.table("orders")
        if since is not None:
            orders = orders.where(f"o_orderdate >= {moment(since)}")
        orders = orders.select(
            "o_orderkey",
            F.expr("CAST(o_custkey AS STRING) AS asgn_id"),
            S.monday_of(F.col("o_orderdate")).alias("pyh_payperiod"),
        )
        lines = self.table("lineitem").selectExpr(
            "l_orderkey",
            f"""{code(spelt("CASE WHEN l_linenumber = 7 THEN 'TRC' ELSE 'DRV' END", "l_suppkey"))} AS asgn_type""",
            f"{code(spelt(pick('l_partkey', PAY_CODES), 'l_linenumber'))} AS pyt_itemcode",
            f"CAST(CASE WHEN l_partkey % {len(PAY_CODES)} = {PAY_CODES.index('FINES')} "
            "THEN -l_quantity ELSE l_quantity END * 10 AS DECIMAL(19,4)) AS pyd_amount",
        )
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")

    # --- safety --------------------------------------------------------------
    def events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "CAST(user_id AS STRING) AS DriverID",
            f"""{code(spelt("CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'X Lane-Departure Y' WHEN event_type = 'view' THEN 'X_Lane_Departure_Y' ELSE event_type END", "event_id"))} AS EventTrigger""",
        )

    def accidents(self) -> DataFrame:
        return self.table("events").where("event_type = 'error'").selectExpr(
            "CAST(user_id AS STRING) AS MISC2_NM",
            "CAST(add_months(CAST(ts AS DATE), -289) AS TIMESTAMP_NTZ) AS REPORT_DT",
            f"""{code(spelt("CASE WHEN event_id % 2 = 0 THEN 'Chargeable' ELSE 'Other' END", "event_id"))} AS SPECIAL23""",
        )

    def names(self) -> DataFrame:
        """Ids with the full name that violations are filed under."""
        name = S.joined_name(F.col("mpp_firstname"), F.col("mpp_lastname"))
        return self.profile().select("mpp_id", name.alias("DriverName"))

    def violations(self) -> DataFrame:
        bought = self.table("events").where("event_type = 'purchase'").selectExpr(
            "CAST(user_id AS STRING) AS id", "CAST(floor(value) AS STRING) AS ViolationValue"
        )
        return bought.join(self.names(), F.col("id") == F.col("mpp_id")).select("DriverName", "ViolationValue")

    def expirations(self) -> DataFrame:
        return self.table("customer").where("c_mktsegment = 'BUILDING'").selectExpr("CAST(c_custkey AS STRING) AS DriverID")

    # --- legs ----------------------------------------------------------------
    def legs(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_orderkey AS STRING) END AS ord_hdrnumber",
            "CASE WHEN l_partkey % 89 <> 0 THEN CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS lgh_number",
            "CASE WHEN l_linenumber = 7 THEN 'UNKNOWN' WHEN l_partkey % 83 = 0 THEN NULL "
            "WHEN l_partkey % 5 = 0 THEN concat(' D', l_suppkey, char(9)) ELSE concat('D', l_suppkey) END AS lgh_driver1",
            "CASE WHEN l_partkey % 4 = 0 THEN 'UNKNOWN' ELSE concat('D', l_partkey % 100) END AS lgh_driver2",
            "l_shipdate AS lgh_startdate",
            "l_shipdate + INTERVAL '1' HOUR * CAST(l_quantity AS INT) AS lgh_enddate",
            code("CASE WHEN l_partkey % 79 = 0 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'solu ' "
                 "WHEN l_returnflag = 'R' THEN 'SOLU' ELSE l_returnflag END") + " AS lgh_class1",
            "l_linestatus AS trc_division",
            "CAST(l_suppkey % 25 AS STRING) AS lgh_startcity",
            "CAST(l_partkey % 26 AS STRING) AS lgh_endcity",
        )

    def city(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "CAST(n_nationkey AS STRING) AS cty_code",
            "concat('Z', n_nationkey) AS cty_zip",
            "n_regionkey + 4 AS cty_GMTDelta",
        )

    # --- survey --------------------------------------------------------------
    def survey(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "CASE WHEN lang = 'en' THEN text END AS whyleft",
            "CASE WHEN lang <> 'en' THEN text END AS whatsgood",
            "CAST(doc_id % 75 AS INT) AS seniority",
            "CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id % 70 AS INT) END AS CVENtime",
        )

    def texts(self) -> DataFrame:
        """The documents, each with one of a few hard cases of word boundaries behind it."""
        return self.table("documents").select("lang", F.concat("text", F.lit(" "), F.expr(pick("doc_id", HARD_WORDS))).alias("text"))

    def stop_words(self) -> DataFrame:
        return small_table(self.spark, {"word": STOP_WORDS})

    def lexicon(self) -> DataFrame:
        words, sentiments = zip(*LEXICON)
        return small_table(self.spark, {"word": words, "sentiment": sentiments})

    # --- human resources -----------------------------------------------------
    def hr(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 13 <> 0").selectExpr(
            "c_custkey AS EMPLOYID",
            "CASE WHEN c_custkey % 17 <> 0 THEN CAST((c_custkey DIV 7) % 4 AS INT) END AS GENDER",
            "c_nationkey % 9 AS ETHNORGN",
            "CAST(c_custkey % 5 AS INT) AS MARITALSTATUS",
        )

    def dependents(self) -> DataFrame:
        return self.table("orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_custkey % 19 = 0").selectExpr(
            "CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey END AS EMPLOYID",
            "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS STRING) END AS DEPENDENTSSN",
        )

    def cohort_labels(self) -> DataFrame:
        return self.profile().selectExpr("mpp_id", "CASE WHEN mpp_status = 'OUT' THEN 0 ELSE 1 END AS stayed")

    def retention(self) -> DataFrame:
        """One row per profile with measures of the person's order lines.

        Lines are summed per order first: that aggregate leaves them placed for
        the join with the orders and shrinks a very large order on the map side.
        """
        per_order = self.table("lineitem").groupBy("l_orderkey").agg(
            F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"), F.count(F.lit(1)).alias("n")
        )
        per_person = (
            per_order.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.expr("CAST(o_custkey AS STRING) AS mpp_id"))
            .agg(
                F.expr("sum(q) / sum(n) AS dayshome"),
                F.expr("sum(d) / sum(n) AS active_driving_day_per"),
                F.expr("CAST(sum(n) AS DOUBLE) AS active_driving_day_count"),
            )
        )
        return self.cohort_labels().join(per_person, "mpp_id", "left")

    # --- together ------------------------------------------------------------
    def pay_side(self) -> Workforce:
        """The tables the pay steps read."""
        pay = self.pay_lines(since=earliest_period(CUTOFF, AS_OF))
        return Workforce(self.profile(), pay, CUTOFF, AS_OF)

    def workforce(self, teaming: DataFrame | None) -> Workforce:
        return replace(
            self.pay_side(),
            events=self.events(),
            accidents=self.accidents(),
            violations=self.violations(),
            teaming=teaming,
        )

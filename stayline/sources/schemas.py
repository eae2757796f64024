"""Declared schemas of the input tables, so that no read infers types."""

from pyspark.sql import types as T

#: Codes are compared, joined and listed without case and end blanks, as the systems they come from do.
COLLATION = "UTF8_LCASE_RTRIM"

TYPES = {
    "CODE": T.StringType(COLLATION),
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL(19,4)": T.DecimalType(19, 4),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    """Schema from 'name TYPE, …'; needs no running session."""
    columns = [column.split(" ") for column in text.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns])


PROFILE = _schema(
    "mpp_id STRING, mpp_terminationdt TIMESTAMP_NTZ, mpp_state STRING, mpp_type1 CODE, "
    "mpp_type2 CODE, mpp_status CODE, mpp_firstname STRING, mpp_lastname STRING, "
    "mpp_currentphone STRING, mpp_hiredate TIMESTAMP_NTZ"
)
PAY_LINES = _schema(
    "asgn_type CODE, asgn_id STRING, pyh_payperiod TIMESTAMP_NTZ, pyt_itemcode CODE, "
    "pyd_amount DECIMAL(19,4), lgh_number BIGINT, mov_number BIGINT, pyd_description STRING, "
    "pyd_rate DECIMAL(19,4), pyd_sequence INT, pyd_branch STRING"
)
SAFETY_EVENTS = _schema("DriverID STRING, EventTrigger CODE")
ACCIDENTS = _schema("MISC2_NM STRING, REPORT_DT TIMESTAMP_NTZ, SPECIAL23 CODE")
VIOLATIONS = _schema("DriverName STRING, ViolationValue STRING")
TEAMING = _schema(
    "rownames STRING, DriverID STRING, team_binary DOUBLE, leg_count BIGINT, "
    "lgh_enddateEST TIMESTAMP_NTZ"
)
LEGS = _schema(
    "ord_hdrnumber STRING, lgh_number STRING, lgh_driver1 STRING, lgh_driver2 STRING, "
    "lgh_startdate TIMESTAMP_NTZ, lgh_enddate TIMESTAMP_NTZ, lgh_class1 CODE, "
    "trc_division STRING, lgh_startcity STRING, lgh_endcity STRING, lgh_tractor STRING"
)
CITY = _schema("cty_code STRING, cty_zip STRING, cty_GMTDelta INT")
SURVEY = _schema("whyleft STRING, whatsgood STRING, seniority INT, CVENtime INT")
WORDS = _schema("word STRING")
LEXICON = _schema("word STRING, sentiment STRING")
HR = _schema("EMPLOYID STRING, GENDER INT, ETHNORGN INT, MARITALSTATUS INT")
DEPENDENTS = _schema("EMPLOYID STRING, DEPENDENTSSN STRING")
RETENTION = _schema(
    "mpp_id STRING, stayed INT, phone STRING, groupavgpay DOUBLE, CSA_month DOUBLE, "
    "Vio_month DOUBLE, sumlayover DOUBLE, avglayover DOUBLE, "
    "student_to_team_driver_days DOUBLE, active_driving_day_per DOUBLE, "
    "active_driving_day_count DOUBLE, dayshome DOUBLE"
)

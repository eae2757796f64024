"""Personal characteristics joined to the retention extract and labelled."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline import constants as K
from stayline.functions import scalars as S

CODES = ["GENDER", "ETHNORGN", "MARITALSTATUS", "DEPENDENTSSN"]


def dependents_per_employee(dependents: DataFrame) -> DataFrame:
    """Number of rows with a dependant's number, per employee.

    The numbers themselves are personal: they are counted at the scan and not
    carried on. An employee whose rows are all blank counts 0.
    """
    return (
        dependents.where(F.col("EMPLOYID").isNotNull())
        .groupBy("EMPLOYID")
        .agg(F.count("DEPENDENTSSN").alias("DEPENDENTSSN"))
    )


def hr_people(hr: DataFrame, dependents: DataFrame) -> DataFrame:
    """HR codes with the dependants count, keyed like the retention extract."""
    return (
        hr.select("EMPLOYID", "GENDER", "ETHNORGN", "MARITALSTATUS")
        .join(dependents_per_employee(dependents), "EMPLOYID", "left")
        .withColumnRenamed("EMPLOYID", "mpp_id")
    )


def retention_people(retention: DataFrame, people: DataFrame) -> DataFrame:
    """The retention extract with the HR codes of each person; unused columns
    go, both ids are compared as text, missing codes become 0."""
    kept = _id_as_text(retention.drop(*K.RETENTION_DROPPED))
    return kept.join(_id_as_text(people), "mpp_id", "left").na.fill(0, CODES)


def _id_as_text(df: DataFrame) -> DataFrame:
    numeric = isinstance(df.schema["mpp_id"].dataType, T.NumericType)
    return df.withColumn("mpp_id", S.text_key(F.col("mpp_id"), numeric))


def labelled(people: DataFrame, mode: str = "as_intended") -> DataFrame:
    """Codes replaced by their labels."""
    labels = {
        "stayed": S.relabel("stayed", K.STAYED_LABELS),
        "GENDER": S.relabel("GENDER", K.GENDER_LABELS),
        "MARITALSTATUS": S.relabel("MARITALSTATUS", K.MARITAL_LABELS),
        "ETHNORGN": S.relabel("ETHNORGN", K.ETHNICITY_LABELS),
        "DEPENDENTSSN": S.dependents_band("DEPENDENTSSN", mode),
    }
    return people.withColumns({name: F.expr(text) for name, text in labels.items()})

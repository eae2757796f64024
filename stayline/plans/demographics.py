"""Personal characteristics of those who stayed and those who left."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from stayline import constants as K
from stayline.operators import crosstab as C
from stayline.operators import demographics as D

MARITAL = ["MARRIED", "SINGLE", "UNKNOWN"]
STAYED = [K.STAYED_LABELS[0], K.STAYED_LABELS[1]]


def people(retention: DataFrame, hr: DataFrame, dependents: DataFrame, mode: str = "as_intended") -> DataFrame:
    coded = D.retention_people(retention, D.hr_people(hr, dependents))
    return D.labelled(coded, mode)


def by_characteristic(labelled: DataFrame, column: str) -> DataFrame:
    """Counts and column shares of the cohorts by one characteristic."""
    return C.with_share(C.crosstab(labelled, "stayed", column), "stayed", column)


def by_family(labelled: DataFrame) -> DataFrame:
    """Counts and column shares by marital status and dependants together."""
    keys = ["MARITALSTATUS", "DEPENDENTSSN"]
    return C.with_share(C.crosstab(labelled, "stayed", keys), "stayed", keys)


def family_means(labelled: DataFrame, value: str, labels: Sequence[str] | None = tuple(MARITAL)) -> DataFrame:
    """Mean of a measure by cohort and dependants, one column per status.

    Pass labels=None when there are codes without a label: Spark then looks up
    the columns first, in one more pass.
    """
    return C.pivot_means(labelled, value, ["stayed", "DEPENDENTSSN"], "MARITALSTATUS", labels)


def cohort(labelled: DataFrame, label: str) -> DataFrame:
    return labelled.where(labelled["stayed"] == label)

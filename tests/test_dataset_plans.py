"""What the dataset of few recordings works on."""

import re

import pytest

from checks.registry import QUERIES
from checks import queries  # noqa: F401  (fills the registry)

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["static_records", "dataset_features"])
def test_only_rows_of_the_cohort_are_worked_on(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert re.search(r"LeftSemi, \(+(hadm_id|subject_id|stay_id)#", text)  # not only the cohort itself, by record_id
    assert "Expand" not in text  # no chunk becomes a row per feature

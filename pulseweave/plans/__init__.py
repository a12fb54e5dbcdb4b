"""User-level pipelines composed from the operators."""

from pulseweave.plans.pipeline import (  # noqa: F401
    build_cohort,
    build_dataset,
    cohort_codes,
    cohort_inputs,
    cohort_labs,
    load_inputs,
    preprocess,
)

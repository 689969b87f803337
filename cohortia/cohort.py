"""Column roles of a long measurement table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cohort:
    """Names the columns an operator works on, so it fits any long table."""

    sample: str = "sample_id"
    assay: str = "assay"
    value: str = "value"
    lod: str = "lod"
    subject: str = "subject"
    visit: str = "visit"
    disease: str = "disease"
    klass: str = "class"
    sex: str = "sex"
    age: str = "age"
    bmi: str = "bmi"


DEFAULT = Cohort()

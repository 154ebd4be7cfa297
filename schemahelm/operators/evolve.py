"""Schema evolution of data tables as one projection: add, retype, set not null, drop."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One change of a table: ``action`` is add, retype, not_null or drop."""

    action: str
    column: str
    data_type: str | None = None
    default: object = None


class Evolved(NamedTuple):
    table: DataFrame
    rejects: DataFrame


def evolve_table(df: DataFrame, plan: list[Step]) -> Evolved:
    """Rewrite a table along a plan; rows that cannot follow go to ``rejects`` with the reasons.

    Adding an existing column and dropping an absent one do nothing. All steps fold into one projection and
    two filters over the same scan.
    """
    problems = []
    for step in plan:
        name = step.column
        present = name in df.columns
        if step.action == "add":
            if not present:
                df = df.withColumn(name, F.lit(step.default).cast(step.data_type))
        elif step.action == "drop":
            df = df.drop(name)
        elif step.action == "retype" and present:
            cast = F.col(name).try_cast(step.data_type)
            bad = F.col(name).isNotNull() & cast.isNull()
            problems.append(f"_p{len(problems)}")
            df = df.withColumn(problems[-1], F.when(bad, F.lit(f"{name}: not {step.data_type}"))).withColumn(name, cast)
        elif step.action == "not_null" and present:
            value = F.coalesce(F.col(name), F.lit(step.default)) if step.default is not None else F.col(name)
            df = df.withColumn(name, value)
            problems.append(f"_p{len(problems)}")
            df = df.withColumn(problems[-1], F.when(F.col(name).isNull(), F.lit(f"{name}: null")))
        elif step.action not in ("retype", "not_null"):
            raise ValueError(f"unknown step: {step.action}")
    reasons = F.concat_ws("; ", *problems) if problems else F.lit("")
    marked = df.withColumn("_reason", reasons).drop(*problems)
    return Evolved(
        marked.where("_reason = ''").drop("_reason"),
        marked.where("_reason <> ''").withColumnRenamed("_reason", "reject_reason"),
    )

"""Facets as checks on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Facets:
    """Constraints on a value; those left None don't count. A null value breaks none."""

    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    pattern: str | None = None
    enumeration: list | None = None
    min_length: int | None = None
    max_length: int | None = None
    length: int | None = None
    total_digits: int | None = None
    fraction_digits: int | None = None

    def failures(self, value: Column, name: str) -> list[Column]:
        """A message per broken facet, null where it holds."""
        text = value.cast("string")
        whole = F.regexp_replace(F.regexp_replace(text, r"\..*$", ""), "^-?0*", "")
        part = F.regexp_extract(text, r"\.(\d*?)0*$", 1)
        broken = {
            "minInclusive": None if self.min_inclusive is None else value < self.min_inclusive,
            "maxInclusive": None if self.max_inclusive is None else value > self.max_inclusive,
            "minExclusive": None if self.min_exclusive is None else value <= self.min_exclusive,
            "maxExclusive": None if self.max_exclusive is None else value >= self.max_exclusive,
            "pattern": None if self.pattern is None else ~text.rlike(f"^(?:{self.pattern})$"),
            "enumeration": None if self.enumeration is None else ~value.isin(self.enumeration),
            "minLength": None if self.min_length is None else F.length(value) < self.min_length,
            "maxLength": None if self.max_length is None else F.length(value) > self.max_length,
            "length": None if self.length is None else F.length(value) != self.length,
            "totalDigits": None if self.total_digits is None else F.length(whole) + F.length(part) > self.total_digits,
            "fractionDigits": None if self.fraction_digits is None else F.length(part) > self.fraction_digits,
        }
        return [F.when(test, F.lit(f"{name}: {facet}")) for facet, test in broken.items() if test is not None]

    def hold(self, value: Column) -> Column:
        """Whether all facets hold (checkConstraints)."""
        failed = self.failures(value, "")
        return F.coalesce(*failed).isNull() if failed else F.lit(True)

"""Job settings: eleven lines read by position, each ``label: value``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    path1: str
    path2: str
    manual_sizes: bool
    spacing1: float
    spacing2: float
    size1: float
    size2: float
    manual_threshold: bool
    dt_first: float
    dt_least: float
    visual: bool

    def __post_init__(self) -> None:
        if self.manual_sizes:
            for spacing, size in ((self.spacing1, self.size1), (self.spacing2, self.size2)):
                if spacing <= 0:
                    raise ValueError("a spacing must be positive")
                if not spacing <= size <= 40 * spacing:
                    raise ValueError("a patch size must be between one and forty spacings")
        if self.manual_threshold:
            if self.dt_first <= 0:
                raise ValueError("the first threshold must be positive")
            if self.dt_first < self.dt_least:
                raise ValueError("the first threshold must not be under the last")


def parse(text: str) -> Settings:
    """The settings of a file's text.  Labels are ignored; a value stands behind the first colon of its line."""
    values = []
    for no, line in enumerate(text.splitlines()[:11], 1):
        _, colon, value = line.partition(":")
        if not colon or not value.strip():
            raise ValueError(f"line {no} has no value")
        values.append(value.strip())
    if len(values) < 11:
        raise ValueError(f"{len(values)} of 11 lines")
    flag = lambda s: int(float(s)) != 0
    number = [float(values[i]) for i in (3, 4, 5, 6, 8, 9)]
    return Settings(values[0], values[1], flag(values[2]), *number[:4], flag(values[7]), *number[4:], flag(values[10]))


def load(spark, path: str) -> Settings:
    """Read through Spark, so that any of its file systems will do."""
    return parse("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))

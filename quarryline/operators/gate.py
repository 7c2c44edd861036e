"""Selection of findings for a gate, and the lists of rules that they come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.findings import ratchet


@dataclass(frozen=True)
class Rule:
    """A metric by name: fn takes a node table and gives file, unit, value (scalar) or file, line (flag)."""

    name: str
    kind: str
    fn: Callable[[DataFrame], DataFrame]
    warn: int | None = None
    high: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("scalar", "flag"):
            raise ValueError(f"{self.name}: a rule is a scalar or a flag, not {self.kind}")
        if self.kind == "scalar" and (self.warn is None or self.high is None):
            raise ValueError(f"{self.name}: a scalar needs both limits of its band")


def chosen(rules: Iterable[Rule], kind: str | None = None, only: set[str] | None = None, bands: dict[str, tuple[int, int]] | None = None) -> list[Rule]:
    """The rules of a kind and of the named ones, the last of equal names, with bands in place of their own."""
    last = {r.name: r for r in rules}
    unknown = (only or set()) | set(bands or {})
    if unknown - set(last):
        raise ValueError(f"no such rule: {', '.join(sorted(unknown - set(last)))}")
    out = [r for r in last.values() if (kind is None or r.kind == kind) and (only is None or r.name in only)]
    return [Rule(r.name, r.kind, r.fn, *(bands or {}).get(r.name, (r.warn, r.high))) for r in out]


def metric_names(rules: Iterable[Rule]) -> frozenset[str]:
    return frozenset(r.name for r in rules)


def measured(nodes: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """file, unit, metric, value, warn, high of all scalar rules."""
    out = None
    for r in chosen(rules, "scalar"):
        part = r.fn(nodes).select("file", "unit", F.lit(r.name).alias("metric"), F.col("value").cast("long").alias("value"), F.lit(r.warn).alias("warn"), F.lit(r.high).alias("high"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no scalar rule")
    return out


def unsuppressed(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.coalesce("suppressed", F.lit(False)))


def high_only(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("absolute") == "high")


def errors(head: DataFrame, base: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """Findings that fail a gate: high and not suppressed, and more than base has of their key."""
    floor = high_only(unsuppressed(head))
    return floor if base is None else ratchet(floor, high_only(unsuppressed(base)), key, order)


def ordered(findings: DataFrame, passes: list[str]) -> DataFrame:
    """Findings in the order of a report: by pass, then the most members or values first, then place."""
    at = F.array_position(F.array(*map(F.lit, passes)), F.col("metric"))
    return findings.orderBy(F.when(at > 0, at).otherwise(len(passes) + 1), F.desc_nulls_last("value"), "file", "line")

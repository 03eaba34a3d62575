"""Rules as data: a code, a severity, a test and a message, run over many entries in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

FINDING = "struct<code:string,sev:string,msg:string,anchor:string>"
FINDING_COLUMNS = ("entry_id", "code", "sev", "msg", "anchor")


@dataclass(frozen=True)
class Rule:
    """One test of an entry. `test` and `message` build Columns over the entries table, so a rule can be made without
    a session; a test that is null does not fire."""

    code: str
    sev: str
    test: Callable[[], Column]
    message: Callable[[], Column]
    anchor: str = ""

    def finding(self) -> Column:
        fired = F.struct(
            F.lit(self.code).alias("code"), F.lit(self.sev).alias("sev"), self.message().cast("string").alias("msg"), F.lit(self.anchor).alias("anchor")
        )
        return F.when(self.test(), fired)


def run_rules(entries: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of all rules: every test sits in one array per entry, so the table is read once for the whole pack."""
    found = F.array_compact(F.array(*[r.finding() for r in rules]))
    return entries.select("entry_id", F.explode(found).alias("f")).select("entry_id", "f.*")


_REGISTERED: dict[str, Callable[..., DataFrame]] = {}


def register_rule(code: str, job: Callable[..., DataFrame]) -> None:
    """Add a rule of one's own: a job from the tables it asks for (by keyword) to findings."""
    if code in _REGISTERED:
        raise ValueError(f"rule {code} is registered twice")
    _REGISTERED[code] = job


def run_registered(**tables: DataFrame) -> DataFrame | None:
    """The union of all registered jobs whose tables are given."""
    out = None
    for job in _REGISTERED.values():
        wanted = job.__code__.co_varnames[: job.__code__.co_argcount]
        if all(name in tables for name in wanted):
            found = job(**{name: tables[name] for name in wanted}).select(*FINDING_COLUMNS)
            out = found if out is None else out.unionByName(found)
    return out

"""Stages in order, each skipped, resumed or stopped at by what the run log says."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources.sinks import log_run, stage_status


@dataclass(frozen=True)
class Stage:
    """A stage's name, and what it does; it returns a line for the log. ``always``: run even if an earlier run completed it."""

    name: str
    run: Callable[[SparkSession], str]
    always: bool = False


@dataclass
class Result:
    name: str
    status: str = "not_run"
    elapsed: float = 0.0
    summary: str = ""


@dataclass
class Report:
    results: list[Result] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(r.status in ("completed", "skipped") for r in self.results)


def orchestrate(spark: SparkSession, stages: list[Stage], log: str, *, only: set[str] | None = None, resume: bool = True, fail_fast: bool = True) -> Report:
    """Runs the stages in order. What the log has as completed is skipped if ``resume``, what ``only`` leaves out is skipped; after a
    failure the rest is not run if ``fail_fast``. Every stage that ran is a row of the log."""
    done, report, failed = stage_status(spark, log) if resume else {}, Report(), False
    for stage in stages:
        result = Result(stage.name)
        report.results.append(result)
        if failed and fail_fast:
            continue
        if (only is not None and stage.name not in only) or (done.get(stage.name) == "completed" and not stage.always):
            result.status = "skipped"
            continue
        began = time.time()
        try:
            result.summary, result.status = stage.run(spark) or "", "completed"
        except Exception as e:  # the stage's own failure, whatever it is, belongs in the log
            result.summary, result.status, failed = f"{type(e).__name__}: {e}"[:500], "failed", True
        result.elapsed = time.time() - began
        log_run(spark, log, stage.name, result.status, result.elapsed, result.summary)
    return report

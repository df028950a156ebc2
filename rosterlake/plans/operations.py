"""Operational changes on stored tables: a batch rewrites the blocks of its employees in both layers."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame

from rosterlake.plans import changes
from rosterlake.session import scratch_scope
from rosterlake.sources.tables import Tables


def _scoped(method):
    """Run a method of `Workforce` in a scratch scope."""

    @wraps(method)
    def run(self, *args, **kwargs):
        with scratch_scope(self.store.spark):
            return method(self, *args, **kwargs)

    return run


class Workforce:
    """Batches of form submissions; every method returns the rows it refused.

    Each batch first writes its outcome beside the tables and then puts it in place, by appending or
    by overwriting the partitions it falls into. Batches must not overlap: there is one writer at a
    time. Intermediate tables are removed, refused rows stay in the batch's folder.
    """

    def __init__(self, store: Tables):
        self.store = store

    def _staged(self, batch: str, **outcome: DataFrame) -> dict[str, DataFrame]:
        """Everything is computed before anything is put in place."""
        return {name: self.store.stage(batch, name, rows) for name, rows in outcome.items()}

    @_scoped
    def update_roles(self, requests: DataFrame, batch: str | None = None) -> DataFrame:
        """Role changes in both layers. A named batch that comes again changes nothing: its outcome
        is computed once, and putting the same outcome in place again gives the same tables."""
        batch, replayable = batch or uuid.uuid4().hex[:12], batch is not None
        names = ("employees", "dim_employee", "refused")
        if replayable and self.store.reached(batch, "staged"):
            outcome = {n: self.store.spark.read.parquet(f"{self.store.root}/batches/{batch}/{n}") for n in names}
        else:
            outcome = self._staged(batch, **self._role_update(requests))
            if replayable:
                self.store.mark(batch, "staged")
        if not (replayable and self.store.reached(batch, "done")):
            self.store.replace_touched("employees", outcome["employees"], batch)
            self.store.replace_touched("dim_employee", outcome["dim_employee"], batch)
            if replayable:
                self.store.mark(batch, "done")
        return outcome["refused"]

    def _role_update(self, requests: DataFrame) -> dict[str, DataFrame]:
        store = self.store
        blocks = store.blocks(requests)
        update = changes.update_employee_roles(
            requests, store.read_blocks("employees", blocks), store.read("departments"), store.read("jobs"),
            store.read_blocks("dim_employee", blocks), store.next_id("dim_employee", "emp_key"),
        )
        return {"employees": update.employees, "dim_employee": update.touched, "refused": update.rejected}

    @_scoped
    def onboard(self, candidates: DataFrame, today: Column) -> DataFrame:
        """New rows; managers are sought among all employees."""
        store = self.store
        hired = changes.onboard(
            candidates, store.read("employees"), store.read("departments"), store.read("jobs"),
            store.read("dim_employee"), today,
            store.next_id("employees", "employee_id"), store.next_id("dim_employee", "emp_key"),
        )
        outcome = self._staged(
            uuid.uuid4().hex[:12], employees=hired.employees, dim_employee=hired.dim_employee, refused=hired.rejected
        )
        store.append("employees", outcome["employees"])
        store.append("dim_employee", outcome["dim_employee"])
        return outcome["refused"]

    @_scoped
    def assign_projects(self, requests: DataFrame) -> DataFrame:
        store, batch = self.store, uuid.uuid4().hex[:12]
        blocks = store.blocks(requests)
        assigned = changes.assign_projects(
            requests, store.read_blocks("project_assignments", blocks), store.read_blocks("employees", blocks),
            store.read("projects"), store.next_id("project_assignments", "assignment_id"),
        )
        outcome = self._staged(batch, project_assignments=assigned.snapshot, refused=assigned.rejected)
        store.replace_touched("project_assignments", outcome["project_assignments"], batch)
        return outcome["refused"]

    @_scoped
    def submit_reviews(self, requests: DataFrame) -> DataFrame:
        store = self.store
        blocks = store.blocks(requests)
        tables = {
            "employees": store.read_blocks("employees", blocks),
            "dim_employee": store.read_blocks("dim_employee", blocks),
            "dim_department": store.read("dim_department"),
            "dim_date": store.read("dim_date"),
        }
        submitted = changes.submit_reviews(
            requests, tables, store.next_id("performance_reviews", "review_id"),
            store.next_id("fact_performance_reviews", "review_fact_id"),
        )
        outcome = self._staged(
            uuid.uuid4().hex[:12], performance_reviews=submitted.performance_reviews,
            fact_performance_reviews=submitted.facts, refused=submitted.rejected,
        )
        for name in ("performance_reviews", "fact_performance_reviews"):
            store.append(name, outcome[name])
        return outcome["refused"]

    @_scoped
    def give_raises(self, requests: DataFrame) -> DataFrame:
        store, batch = self.store, uuid.uuid4().hex[:12]
        raised = changes.apply_raises(requests, store.read_blocks("employees", store.blocks(requests)))
        outcome = self._staged(batch, employees=raised.employees, refused=raised.rejected)
        store.replace_touched("employees", outcome["employees"], batch)
        return outcome["refused"]

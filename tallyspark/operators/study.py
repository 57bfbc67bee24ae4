"""A resumable study: selection on validation rows, one final test, and an append-only audit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tallyspark.operators.research import candidate_losses

AUDIT = "sequence long, event string, candidate string, metric string, value double, n_obs long, status string, split_id string, parameters string"


class ResearchStudy:
    """Chooses a candidate on the validation partition and evaluates it once on the test partition.

    The audit is the memory: a study built from a prior audit knows what was selected and whether its test
    rows were seen. A second use of a partition must be asked for and is recorded as exploratory.
    """

    def __init__(self, split: DataFrame, split_id: str, prior_audit: list[tuple] | None = None):
        self.split, self.split_id, self.rows = split, split_id, list(prior_audit or [])
        if [r[0] for r in self.rows] != list(range(1, len(self.rows) + 1)):
            raise ValueError("a prior audit must be the complete sequence from 1")

    @property
    def audit(self) -> DataFrame:
        return self.split.sparkSession.createDataFrame(self.rows, AUDIT)

    @property
    def selection(self) -> str | None:
        """The candidate that the latest selection of this split chose."""
        picked = [r[2] for r in self.rows if r[1] == "validation_selection" and r[7] == self.split_id and json.loads(r[8])["selected"]]
        return picked[-1] if picked else None

    def _used(self, event: str) -> bool:
        return any(r[1] == event and r[7] == self.split_id for r in self.rows)

    def _record(self, event: str, losses: list, metric: str, status: str, parameters: dict) -> None:
        for r in losses:
            self.rows.append(
                (
                    len(self.rows) + 1, event, r.candidate, metric, r.loss, r.n_obs, status, self.split_id,
                    json.dumps(parameters | {"selected": bool(r.selected)}, sort_keys=True),
                )
            )

    def _losses(self, predictions: DataFrame, partition: str, metric: str) -> list:
        rows = self.split.where(f"partition = '{partition}' and reason = 'included'").select("session", "asset", "target")
        candidates = predictions.select("candidate").distinct().count()
        off = rows.join(predictions, ["session", "asset"], "left").groupBy("session", "asset").count().where(f"count <> {candidates}")
        extra = predictions.join(rows, ["session", "asset"], "left_anti")
        if not candidates or off.limit(1).count() or extra.limit(1).count():
            raise ValueError(f"predictions must have every {partition} row once for each candidate")
        return candidate_losses(predictions, rows, metric).orderBy("candidate").collect()

    def select(self, predictions: DataFrame, parameters: dict, metric: str = "mse", tie_break: str = "raise", reuse: str = "raise") -> str:
        if self._used("test_evaluation") and reuse != "exploratory":
            raise ValueError("the test rows were seen: a further selection must be exploratory")
        losses = self._losses(predictions, "validation", metric)
        best = min(r.loss for r in losses)
        if tie_break == "raise" and sum(r.loss == best for r in losses) > 1:
            raise ValueError("several candidates have the lowest loss")
        self._record("validation_selection", losses, metric, "exploratory" if self._used("test_evaluation") else "validation", parameters)
        return self.selection

    def evaluate_test(self, predictions: DataFrame, metric: str = "mse", reuse: str = "raise") -> float:
        if self.selection is None:
            raise ValueError("select a candidate first")
        again = self._used("test_evaluation")
        if again and reuse != "exploratory":
            raise ValueError("the test rows were used: a further evaluation must be exploratory")
        if [r[0] for r in predictions.select("candidate").distinct().limit(2).collect()] != [self.selection]:
            raise ValueError("only the selected candidate may be tested")
        losses = self._losses(predictions, "test", metric)
        self._record("test_evaluation", losses, metric, "exploratory" if again else "final_test", {})
        return losses[0].loss

"""The sealed holdout: registered predictions, logged accesses, verdicts.

Metadata is a few small files on the driver; the data itself stays lazy.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOLDOUT_START = "2023-01-01"


class HoldoutViolation(RuntimeError):
    """The holdout was to be used in a way that it is sealed against."""


def split_research_holdout(df: DataFrame, start: str = HOLDOUT_START, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows before the cut, and rows at or after it."""
    cut = F.lit(start).cast("timestamp")
    return df.where(F.col(ts) < cut), df.where(F.col(ts) >= cut)


def research_only(df: DataFrame, start: str = HOLDOUT_START, ts: str = "ts", first: str | None = None) -> DataFrame:
    """Rows before the cut and, if given, not before ``first``; the way to read by default."""
    out = split_research_holdout(df, start, ts)[0]
    return out.where(F.col(ts) >= F.lit(first).cast("timestamp")) if first else out


@dataclass(frozen=True)
class PreRegistration:
    """What is expected of the holdout, written down before it is opened."""

    hypothesis_id: str
    description: str
    symbol: str
    timeframe: str
    model: str
    horizon: int
    predicted_net_sharpe: float
    tolerance: float = 0.5
    rationale: str = ""
    created_utc: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    version: int = 1


@dataclass(frozen=True)
class Registry:
    """Registrations and the access log in one folder."""

    root: Path

    def path(self, hypothesis_id: str) -> Path:
        return self.root / f"{hypothesis_id}.json"

    @property
    def log(self) -> Path:
        return self.root / "access.jsonl"

    def save(self, p: PreRegistration) -> Path:
        self.root.mkdir(parents=True, exist_ok=True)
        try:
            with open(self.path(p.hypothesis_id), "x", encoding="utf-8") as f:
                json.dump(asdict(p), f, indent=2)
        except FileExistsError as e:
            raise HoldoutViolation(f"{p.hypothesis_id} is registered already; take a new id") from e
        return self.path(p.hypothesis_id)

    def load(self, hypothesis_id: str) -> PreRegistration:
        if not self.path(hypothesis_id).exists():
            raise HoldoutViolation(f"{hypothesis_id} is not registered: write down what you expect first")
        return PreRegistration(**json.loads(self.path(hypothesis_id).read_text(encoding="utf-8")))

    def accesses(self, hypothesis_id: str) -> int:
        if not self.log.exists():
            return 0
        return sum(json.loads(x)["hypothesis_id"] == hypothesis_id for x in self.log.read_text(encoding="utf-8").splitlines() if x.strip())

    def unlock(self, df: DataFrame, hypothesis_id: str, start: str = HOLDOUT_START, ts: str = "ts") -> DataFrame:
        """The holdout rows; the access is on record before they are handed out."""
        self.load(hypothesis_id)
        held = split_research_holdout(df, start, ts)[1]
        n, low, high = held.agg(F.count(F.lit(1)), F.min(ts).cast("string"), F.max(ts).cast("string")).first()
        entry = {"hypothesis_id": hypothesis_id, "at": datetime.now(timezone.utc).isoformat(), "rows": n, "from": low, "to": high, "access": self.accesses(hypothesis_id) + 1}
        with open(self.log, "a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")
        return held

    def verdict(self, hypothesis_id: str, observed: float, degenerate: list[str] | None = None) -> dict:
        """Confirmed only near the prediction, above 0, and with nothing degenerate."""
        p = self.load(hypothesis_id)
        near = abs(observed - p.predicted_net_sharpe) <= p.tolerance and observed > 0
        bad = list(degenerate or [])
        word = "INCONCLUSIVE (degenerate)" if bad else "CONFIRMED" if near else "REFUTED"
        return {"hypothesis_id": hypothesis_id, "predicted": p.predicted_net_sharpe, "observed": observed, "delta": observed - p.predicted_net_sharpe, "tolerance": p.tolerance, "within_tolerance": near, "degeneracy": bad, "confirmed": near and not bad, "verdict": word, "accesses": self.accesses(hypothesis_id)}

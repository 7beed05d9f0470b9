"""Experiment description and the schema guards that run at operator heads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

# Fixed values of the experiment layout (column names, roles, design share).
DEFAULT_FEATURES = tuple(f"f{i}" for i in range(12))
DEFAULT_CONTINUOUS = ("f0", "f2", "f7", "f10")
DEFAULT_CATEGORICAL = ("f1", "f3", "f4", "f5", "f6", "f8", "f9", "f11")
DEFAULT_OUTCOMES = ("visit", "conversion")
EXPECTED_TREATMENT_SHARE = 0.85
TREATMENT_PROPENSITY = 0.85
BALANCE_THRESHOLD = 0.10
MINIMUM_CONTROL_EVENTS = 20


class ValidationError(RuntimeError):
    """A table or a declaration failed a check."""


@dataclass(frozen=True)
class ExperimentSpec:
    """Names and roles of the experiment table's columns.

    ``features`` is the declared feature set; continuous and categorical
    roles must partition it exactly (no overlap, duplicate, gap or extra).
    """

    treatment: str = "treatment"
    exposure: str | None = "exposure"
    outcomes: tuple[str, ...] = DEFAULT_OUTCOMES
    continuous: tuple[str, ...] = DEFAULT_CONTINUOUS
    categorical: tuple[str, ...] = DEFAULT_CATEGORICAL
    features: tuple[str, ...] = DEFAULT_FEATURES
    id: str = "id"
    expected_share: float = EXPECTED_TREATMENT_SHARE
    propensity: float = TREATMENT_PROPENSITY

    def __post_init__(self) -> None:
        check_roles(self)
        if not 0 < self.expected_share < 1:
            raise ValidationError(f"expected_share must lie between 0 and 1, not {self.expected_share}")
        if not 0 < self.propensity < 1:
            raise ValidationError(f"propensity must lie between 0 and 1, not {self.propensity}")

    @property
    def binaries(self) -> tuple[str, ...]:
        extra = (self.exposure,) if self.exposure else ()
        return (self.treatment, *extra, *self.outcomes)

    @property
    def model_columns(self) -> tuple[str, ...]:
        """Columns a model may read: features, assignment, outcomes (no exposure)."""
        return (*self.features, self.treatment, *self.outcomes)

    def require_columns(self, df: DataFrame, columns: Sequence[str] | None = None) -> None:
        """Fail with the missing names if ``df`` lacks any needed column."""
        need = list(columns) if columns is not None else [*self.features, *self.binaries]
        missing = sorted(set(need).difference(df.columns))
        if missing:
            raise ValidationError(f"missing required columns: {', '.join(missing)}")

    def validate_model_features(self, names: Sequence[str]) -> None:
        """Leakage guard: model inputs are exactly the declared features."""
        problems = []
        for name in dict.fromkeys([*names, *self.features]):
            role = "feature" if name in self.features else (
                "known only after assignment" if name in self.binaries else "undeclared")
            if names.count(name) != (role == "feature"):
                problems.append(f"{name} ({role}) given {names.count(name)} times")
        if problems:
            raise ValidationError("model inputs must be the declared features, each once, "
                                  "none missing: " + "; ".join(problems))


def check_roles(spec: ExperimentSpec) -> None:
    """Every declared feature has exactly one role, and nothing else has any."""
    roles: dict[str, list[str]] = {name: [] for name in spec.features}
    for role in ("continuous", "categorical"):
        for name in getattr(spec, role):
            roles.setdefault(name, []).append(role)
    problems = []
    for name, given in roles.items():
        if name not in spec.features:
            problems.append(f"{name} is {given[0]} but no feature")
        elif not given:
            problems.append(f"{name} has no role")
        elif len(set(given)) > 1:
            problems.append(f"{name}: roles overlap")
        elif len(given) > 1:
            problems.append(f"{name} is declared {given[0]} {len(given)} times")
    if problems:
        raise ValidationError("feature roles: " + "; ".join(problems))


def identify_columns(column_names: Sequence[str], spec: ExperimentSpec | None = None) -> dict:
    """The required binaries, and every other column as a feature."""
    spec = spec or ExperimentSpec()
    absent = set(spec.binaries).difference(column_names)
    others = [c for c in column_names if c not in spec.binaries]
    if absent or not others:
        raise ValidationError("the table lacks " + ", ".join(
            sorted(absent) + ([] if others else ["any feature column"])))
    return {"binaries": list(spec.binaries), "features": others}

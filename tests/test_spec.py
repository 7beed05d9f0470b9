"""Column-role validation and the leakage guard."""

import pytest

from liftlab.spec import ExperimentSpec, ValidationError, identify_columns


def test_overlapping_roles_rejected():
    with pytest.raises(ValidationError, match="overlap"):
        ExperimentSpec(continuous=("f0",), categorical=tuple(f"f{i}" for i in range(12)))


def test_missing_required_column_is_named():
    with pytest.raises(ValidationError, match="exposure"):
        identify_columns(["f0", "f1", "treatment", "conversion", "visit"])


def test_identify_columns_keeps_every_other_column_as_feature():
    roles = identify_columns(["f0", "f1", "treatment", "conversion", "visit", "exposure"])
    assert roles["features"] == ["f0", "f1"]


@pytest.mark.parametrize("leak", ["treatment", "exposure", "visit", "conversion"])
def test_leakage_guard(leak):
    spec = ExperimentSpec()
    with pytest.raises(ValidationError):
        spec.validate_model_features([*spec.features, leak])


def test_feature_set_must_match():
    spec = ExperimentSpec()
    with pytest.raises(ValidationError, match="missing"):
        spec.validate_model_features(list(spec.features)[:-1])

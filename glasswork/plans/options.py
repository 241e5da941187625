"""Options of a run, resolved from the same nested dictionary a JSON config holds."""

from __future__ import annotations

from dataclasses import dataclass, field

CALIBRATIONS = ("auto", "sigmoid", "isotonic")


def _on(value) -> bool:
    return value is True or str(value).lower() == "true"


@dataclass(frozen=True)
class Options:
    target: str
    features: tuple[str, ...]
    model_params: dict = field(default_factory=dict)
    max_rows: int | None = None
    cv_type: str = "kfold_cv"
    time_column: str | None = None
    oot_rows: int = 0
    upsampling: bool = False
    # Largest number of feature cells per class before upsampling; None keeps all rows.
    max_cells: int | None = None
    calibration: str | None = None
    sql_split: bool = False
    sql_decimals: int = 15
    seed: int = 42

    @property
    def time_series(self) -> bool:
        # Both spellings of the option are in use.
        return self.cv_type in ("timeseriesplit", "timeseriessplit")

    @classmethod
    def from_config(cls, config: dict, columns) -> "Options":
        """Defaults: all columns but the target as features, plain folds, no holdout, no upsampling."""
        target = config["target"]
        if target not in columns:
            raise ValueError(f"target {target} is not a column")
        features = tuple(config.get("features") or [c for c in columns if c != target])
        missing = [f for f in features if f not in columns]
        if missing:
            raise ValueError(f"features {missing} are not columns")
        pre, post = config.get("pre_params") or {}, config.get("post_params") or {}
        oot = _on(pre.get("oot_set")) and "oot_rows" in pre
        upsampling = _on(pre.get("upsampling"))
        calibration = post.get("calibration", "auto" if upsampling else "false")
        calibration = "auto" if _on(calibration) else calibration
        options = cls(
            target=target, features=features, model_params=dict(config.get("model_params") or {}),
            max_rows=int(pre["max_rows"]) if pre.get("max_rows") else None,
            cv_type=pre.get("cv_type", "kfold_cv"), time_column=pre.get("time_sensitive_column"),
            oot_rows=int(pre["oot_rows"]) if oot else 0, upsampling=upsampling,
            max_cells=int(pre["max_cells"]) if pre.get("max_cells") else None,
            calibration=calibration if calibration in CALIBRATIONS else None,
            sql_split=_on(post.get("sql_split")), sql_decimals=int(post.get("sql_decimals", 15)))
        if (options.time_series or options.oot_rows) and not options.time_column:
            raise ValueError("time_sensitive_column is needed for a time split or an out-of-time set")
        return options

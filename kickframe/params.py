"""Model and pipeline constants.

Fixed values: they must equal the published defaults for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EloParams:
    k_factor: float = 32.0
    home_advantage: float = 65.0
    initial_rating: float = 1500.0
    neutral_factor: float = 0.0


@dataclass(frozen=True)
class FeatureParams:
    window: int = 5
    min_observations: int = 3
    h2h_last: int = 5
    h2h_min: int = 2
    sot_conversion: float = 0.30
    shot_conversion: float = 0.03
    max_rest_days: int = 30
    default_rest_days: int = 14
    fatigue_days: int = 3


@dataclass(frozen=True)
class ScoreParams:
    max_goals: int = 10
    half_life_days: float = 540.0
    ridge: float = 1e-3
    home_start: float = 0.25
    tau_floor: float = 1e-10
    top_scorelines: int = 5
    blend_weight: float = 0.4
    blend_grid: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


@dataclass(frozen=True)
class CrossLeagueParams:
    dixon_coles_weight: float = 0.0
    min_matches_per_team: int = 10
    draw_rate: float = 0.22
    weight_grid: tuple[float, ...] = tuple(i / 20 for i in range(21))
    draw_grid: tuple[float, ...] = (0.16, 0.18, 0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.32)
    holdout_seasons: int = 5
    season_start_month: int = 7
    min_holdout_matches: int = 30
    bootstrap_samples: int = 2000
    bootstrap_seed: int = 42
    confidence_level: float = 0.95


@dataclass(frozen=True)
class TrainingParams:
    test_size: float = 0.2
    random_state: int = 42
    lr_max_iter: int = 1000
    lr_c: float = 0.5
    rf_trees: int = 200
    rf_depth: int = 8
    rf_leaf: int = 10
    gbt_rounds: int = 400
    gbt_depth: int = 3
    gbt_rate: float = 0.01
    gbt_subsample: float = 0.8
    gbt_columns: float = 0.9
    vote_weights: tuple[int, int, int] = (1, 1, 2)
    half_life_days: float = 540.0
    decay_enabled: bool = True
    calibration_enabled: bool = True
    calibration_method: str = "sigmoid"
    calibration_fraction: float = 0.15
    folds: int = 5
    search_draws: int = 25
    search_grid: dict = field(
        default_factory=lambda: {
            "n_estimators": [100, 200, 300, 400],
            "max_depth": [3, 4, 5, 6],
            "learning_rate": [0.01, 0.03, 0.05, 0.1],
            "subsample": [0.7, 0.8, 0.9, 1.0],
            "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
        }
    )


@dataclass(frozen=True)
class ValueParams:
    min_edge: float = 0.03
    ml_weight: float = 0.5
    bookmaker_weight: float = 0.3
    kelly_cap: float = 0.25
    floor: float = 1e-6


@dataclass(frozen=True)
class InsightParams:
    recent_matches: int = 10
    h2h_matches: int = 10
    form_length: int = 5
    max_scorelines: int = 5
    fallback_goals: float = 1.35


ELO = EloParams()
FEATURES = FeatureParams()
SCORES = ScoreParams()
CROSS = CrossLeagueParams()
TRAINING = TrainingParams()
VALUE = ValueParams()
INSIGHTS = InsightParams()

# Fixed value: the draw share of the calibration study.
CALIBRATION_DRAW_RATE = 0.26
MIN_NEW_MATCHES = 800
STALE_AFTER_SECONDS = 300
SETTLEMENT_WINDOW_DAYS = 4
SUGGESTION_COUNT = 5
SUGGESTION_CUTOFF = 0.4

# A key with more rows than this is split by day instead of being given to one task.
HOT_KEY_ROWS = 1_000_000
# Rows of one rating pool walked by a single task before it is cut into eras.
ERA_ROWS = 500_000

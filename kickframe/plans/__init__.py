"""Multi-step jobs: score-model fits, model training, backtests."""

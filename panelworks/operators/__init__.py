"""Panel operators: quality, features, regimes, targets, drift, scoring, evaluation, backtests."""

"""DataFrame operators for corpus audit, sampling, rollout scoring and evaluation on Spark."""

"""Multi-step jobs: features, models, scoring, similarity."""

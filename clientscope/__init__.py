"""Client analytics as Spark jobs: tiering, category scoring, rolling features, targets, scoring and evaluation."""

"""Work made of several Spark jobs: scoring, training, checkpoints, the profile store."""

"""The two workloads: student progress and ratings."""

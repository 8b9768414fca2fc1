"""Time-series, manifold and corpus analytics expressed as Spark jobs."""

"""Where rows lie: external Parquet, and the engine's own versioned tables."""

"""Where rows come from: parquet tables, signals made of tables, WAV files."""

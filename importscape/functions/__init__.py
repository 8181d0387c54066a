"""Column functions: paths, source text, symbols. No Python runs on executors for these."""

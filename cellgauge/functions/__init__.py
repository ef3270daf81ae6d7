"""Column expressions; no DataFrame is touched here."""

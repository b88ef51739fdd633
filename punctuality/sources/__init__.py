"""Reading archives, staged text and tables; writing curated tables, results and bundles."""

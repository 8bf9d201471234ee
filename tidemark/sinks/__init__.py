"""Writers. Each dedupes by key itself, since files enforce none."""

"""Per-row expressions: angles, pixel ids and separation bins."""

"""Plans: criteria, the dimension catalog, per-course and all-course analyses."""

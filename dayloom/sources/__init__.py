"""Reading source tables, storing results, checking schemas."""

"""Layer runs: which tables are built from which, gated, written, profiled and recorded."""

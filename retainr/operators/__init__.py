"""Distributed operators Spark has no single built-in for: exact global rank / NTILE / equal-count
bins / running sums without a single-partition window (``ranking``), and size-checked broadcast
plus a hash-joined date-range join (``joins``)."""

"""The analyses, each a lazy function from canonical-table DataFrames to a DataFrame:
``cohorts``, ``kpis``, ``experiments``, ``rfm``, ``features``, ``churn``, ``quality``, ``charts``;
``registry`` names them for the driver contract."""

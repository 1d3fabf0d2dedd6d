"""Training-data operators: one module per operator, thin ``opN_*`` queries in ``queries``.

Nothing else in the library imports this package; it can be removed as a whole.
"""

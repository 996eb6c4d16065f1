"""Training-data operators: one module per operator, all DataFrame in, DataFrame out.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators: ten corpus-scale jobs, each its own module.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators: ten distributed text operators and their queries.

Nothing outside this subpackage imports it; every operator lives in its own module and
``queries.py`` registers them.
"""

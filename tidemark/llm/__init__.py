"""Training-data operators: toxicity, language, mixing, decontamination, chat, near-duplicates, LM, HTML, URLs,
fill-in-the-middle, ranked search, quality.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; Python runs inside tasks only, on Arrow batches.
"""

# What runs inside tasks travels by value, so executors need numpy, pyarrow and pandas but not this package on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older pickler: ship the package with --py-files instead
    pass

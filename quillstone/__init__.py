"""quillstone: evidence-checked text and usage analytics as Spark jobs."""

import copyreg
import functools
import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so that executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _again(function, most):
    return functools.lru_cache(maxsize=most)(function)


# so do those that remember their answers, with an empty memory
copyreg.pickle(type(functools.lru_cache(len)), lambda f: (_again, (f.__wrapped__, f.cache_parameters()["maxsize"])) if f.__module__.startswith(__name__) else f.__qualname__)

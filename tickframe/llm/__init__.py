"""Training-data operators: near-duplicates, sharding, quality, language-model scores, HTML, mixing,
decontamination, quotation linking, secrets and personal data.

Nothing outside this subpackage imports it. Its functions are pickled by value, so executors need the
libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing training data at scale; nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

from . import ann, common, jaccard, licenses, lm, logistic, mixing, packing, phrases, pii, quality, radix, rans, tokens, toxicity, trie, warc, words

# Functions that run inside tasks travel by value, so executors need no copy of this package.
for _module in (ann, common, jaccard, licenses, lm, logistic, mixing, packing, phrases, pii, quality, radix, rans, tokens, toxicity, trie, warc, words):
    cloudpickle.register_pickle_by_value(_module)

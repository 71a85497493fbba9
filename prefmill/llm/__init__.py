"""Operators of a training-data pipeline. Nothing else in the package imports this one.

wordbytes      words, lines and n-grams of Arrow text columns as numpy arrays (used inside tasks)
tables         cutting lineage, sizes, stable hashes
components     connected components of an edge table
quality        10  quality rules by distribution divergence
langid          2  nearest-centroid language identification
simhash         1  near-duplicates by SimHash and pivot distances
decontaminate   5  benchmark passages by spaced seeds
mixing          4  mixing sources to target weights
toxicity        8  toxic spans by a linear-chain CRF
htmltext        3  main text of pages by a tree-structured model
warc            7  archives written, read and assembled into captures
toolchat        6  tool calls linked, checked and serialised
ngramlm         9  stupid-backoff language-model scores
lexical        11  ranked lexical search by dense blocked products
alignment      12  tokens of two tokenizers aligned by composed fragments
partitions     13  nearest neighbours by learned partitions of a neighbour graph
queries            one registered query for each of them
"""

import sys

from pyspark import cloudpickle

# The workers get these modules by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: dedup, classifiers, tokenisation, archives and chat formatting.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""

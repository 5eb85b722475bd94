"""Training-data operators: license scans, deduplication, archives, classifiers, mixing and token files.

Nothing outside this subpackage imports it.
"""

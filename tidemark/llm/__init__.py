"""Training-data operators: language id, decontamination, chat rendering, toxicity, personal data,
near duplicates, web-archive derivatives, byte-level BPE, graded quality and document fingerprints.

Nothing outside this subpackage imports it.
"""

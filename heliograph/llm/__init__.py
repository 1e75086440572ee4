"""Training-data operators: token counts, toxicity, chat formatting, binary output,
packing, near-dedup, PII, quality rules, decontamination and line dedup.

Nothing outside this subpackage imports it.
"""

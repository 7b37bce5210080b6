"""Training-data operators: extraction, packing, quality, WARC, toxicity, licences, decontamination, PII, near-dedup, token counts.

Nothing outside this subpackage imports it; its queries are in ``llm.catalog``.
"""

"""Training-data operators: extraction, quality, PII, dedup, decontamination,
mixing, toxicity, language id and URL filters. Nothing outside imports this
subpackage; the registered queries are in ``queries``."""

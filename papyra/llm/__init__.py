"""Training-data operators: toxicity, deduplication, decontamination,
tokenisation, personal data, sharding. Nothing outside this package imports
it; its queries are registered by ``papyra.llm.queries``."""

"""Loads every query module of this folder."""

from driftline.llm.registry import ORACLES, QUERIES  # noqa: F401
from driftline.llm import q_alignment, q_ann, q_decontamination, q_html, q_language, q_line_dedup, q_ngram_join  # noqa: F401
from driftline.llm import q_packing, q_pii, q_quality, q_sharding, q_toxicity, q_vector_codes  # noqa: F401

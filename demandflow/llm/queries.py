"""The registered queries of the text operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from demandflow.llm import chat_format, class_model, decontaminate, language_id, mixing, near_dedup, neighbours, packing, secrets, token_counts, turn_repair, urls, whitening

ALL = {**class_model.QUERIES, **language_id.QUERIES, **mixing.QUERIES, **urls.QUERIES, **secrets.QUERIES, **decontaminate.QUERIES, **near_dedup.QUERIES, **neighbours.QUERIES, **packing.QUERIES, **token_counts.QUERIES, **turn_repair.QUERIES, **whitening.QUERIES, **chat_format.QUERIES}

"""Runnable jobs: ``python -m jobs.answer_questions`` and ``python -m jobs.embed_chunks``."""

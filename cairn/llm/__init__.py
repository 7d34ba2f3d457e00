"""Training-data operators: token counts, quality resampling, token files,
line and document deduplication, BPE transducer, n-gram join, language model,
licence scan and benchmark decontamination.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""

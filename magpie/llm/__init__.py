"""Operators for preparing large training corpora (text, pages, tokens).

Nothing outside this subpackage imports it; it needs Spark, numpy, pyarrow, zstandard, tokenizers and a
place of tokenizer vocabularies (public_tokenizers).
"""

"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from functools import wraps

from protolith.llm import bpe, embeddings, exact, language, mix, near, secrets, tokens_out, toxicity, urls
from protolith.llm._common import ship


def _shipped(f):
    @wraps(f)
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {
    f.__name__: _shipped(f)
    for f in (bpe.op1_bpe, language.op2_language_id, mix.op3_mix_sources, secrets.op4_secret_scan, near.op5_near_dedup, tokens_out.op6_token_output, urls.op7_url_filter, exact.op8_exact_dedup, embeddings.op9_embedding_dedup, toxicity.op10_toxicity)
}
SQL = {"op3_mix_sources": mix.SQL, "op7_url_filter": urls.sql(), "op8_exact_dedup": exact.SQL}

"""Queries and SQL of this subpackage, by the names under which the driver knows them."""

from __future__ import annotations

from .decontaminate import op7_decontamination
from .html_text import op1_html_extraction
from .langid import op2_language_id
from .ngram_join import op10_ngram_join
from .pieces import op5_sentencepiece
from .quality import op9_quality_rules
from .secrets import op8_secret_scan
from .substring_dedup import op3_substring_dedup
from .token_files import op6_token_files
from .url_filter import ORACLE as URL_FILTER_SQL
from .url_filter import op4_url_filter


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_html_extraction,
    op2_language_id,
    op3_substring_dedup,
    op4_url_filter,
    op5_sentencepiece,
    op6_token_files,
    op7_decontamination,
    op8_secret_scan,
    op9_quality_rules,
    op10_ngram_join,
    pipeline,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": URL_FILTER_SQL}

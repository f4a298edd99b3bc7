"""The registered queries of this package; __spark_entry__.py adds them if it can import this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from matchengine.llm.bpe_chunks import op4_bpe
from matchengine.llm.divergence import SQL as DIVERGENCE_SQL
from matchengine.llm.divergence import op12_source_divergence
from matchengine.llm.html_extract import op3_html
from matchengine.llm.kneser_ney import op8_lm_score
from matchengine.llm.merkle import SQL as MERKLE_SQL
from matchengine.llm.merkle import op11_merkle_manifest
from matchengine.llm.mixing import op5_mixing
from matchengine.llm.quality import op10_quality_rules
from matchengine.llm.quartile_digest import op6_fingerprints
from matchengine.llm.simhash import op2_simhash
from matchengine.llm.substring_dedup import SQL as SUBSTRING_SQL
from matchengine.llm.substring_dedup import op13_substring_dedup
from matchengine.llm.suffix_dedup import op7_suffix_dedup
from matchengine.llm.token_counts import op1_token_counts
from matchengine.llm.token_store import op9_token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_simhash, op3_html, op4_bpe, op5_mixing, op6_fingerprints, op7_suffix_dedup, op8_lm_score, op9_token_ids, op10_quality_rules, op11_merkle_manifest, op12_source_divergence, op13_substring_dedup)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_substring_dedup": SUBSTRING_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

"""The queries of this subpackage: ``opN_<name>`` for each operator, and ``pipeline``."""

from __future__ import annotations

import importlib.util
import pathlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ranking
from .alignment import op12_token_alignment
from .boilerplate import op13_main_text
from .chat import BEGIN, CONTROL, END, HEAD, op8_chat_format
from .chunking import op5_chunk_fingerprints
from .decontaminate import op3_decontaminate
from .lm import op2_lm_scores
from .packing import op10_best_two_fit
from .ranking import op11_ranked_search
from .simhash import op1_simhash
from .token_counts import op4_token_counts
from .token_shards import op7_token_shards
from .toxicity import op9_toxicity
from .warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_lm_scores, op3_decontaminate, op4_token_counts, op5_chunk_fingerprints, op6_warc, op7_token_shards, op8_chat_format, op9_toxicity, op10_best_two_fit, op11_ranked_search, op12_token_alignment, op13_main_text)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_pipeline.run`` of the file at the repository's top, whatever the working folder is."""
    top = pathlib.Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", top)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
#: Base 32 of 160 bits in hexadecimal: five digits are four characters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))
_CONTROL = "|".join(re.escape(c).replace("'", "''") for c in CONTROL)

SQL: dict[str, str] = {
    "op11_ranked_search": ranking.SQL,
    "op6_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), k AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p JOIN k USING (h)""",
    "op8_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}|\\\\')) + len(regexp_extract_all(text, '{_CONTROL}|\\\\')) + {len(BEGIN + HEAD + END) + 1} AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
}

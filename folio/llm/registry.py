"""The subpackage's queries and their SQL, for __spark_entry__.py."""

import corpus_pipeline
from folio.llm.bpe import op4_bpe
from folio.llm.covertree import op3_embeddings
from folio.llm.merkle import op8_merkle
from folio.llm.lm import op1_lm
from folio.llm.packing import op10_packing
from folio.llm.pii import op2_pii
from folio.llm.quality import op7_quality
from folio.llm.simhash import op9_simhash
from folio.llm.toxicity import op6_toxicity
from folio.llm.warc import op5_warc

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
     f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (digest)
"""


def warc_query(spark, sf_dir):
    return op5_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_lm": op1_lm,
    "op2_pii": op2_pii,
    "op3_embeddings": op3_embeddings,
    "op4_bpe": op4_bpe,
    "op5_warc": warc_query,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_merkle": op8_merkle,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op5_warc": WARC_SQL}

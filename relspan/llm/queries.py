"""The queries opN_<name> of this package and the SQL that holds their results; spotsigs_classes is op8's operator on a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relspan.llm import decontaminate, extract, lengths, mixing, quality, simhash, spotsigs, token_records, toxicity, warc
from relspan.llm.common import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_json() -> str:
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return f.read()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: decontaminate.digest(decontaminate.decontaminate(table(s, d, "documents"), table(s, d, "benchmark"))),
        "op2_toxicity": lambda s, d: toxicity.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op3_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
        "op4_quality": lambda s, d: quality.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op5_warc": lambda s, d: warc.archive_round_trip(table(s, d, "pages")),
        "op6_token_lengths": lambda s, d: lengths.digest(table(s, d, "documents"), tokenizer_json()),
        "op7_html_text": lambda s, d: extract.extract_text(table(s, d, "pages")),
        "op8_spotsigs": lambda s, d: spotsigs.next_to_each(table(s, d, "documents")),
        "spotsigs_classes": lambda s, d: spotsigs.near_duplicates(table(s, d, "documents")),
        "op9_simhash": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op10_token_records": lambda s, d: token_records.token_records(table(s, d, "documents"), tokenizer_json(), END_ID),
    }


_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS t FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, ks WHERE len(w) >= k),
hit AS (SELECT dw.r, dw.s, win.k, win.item_id FROM (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS t FROM dw) dw JOIN win USING (k, t)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""

_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_total,
         coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(w) OVER o, 0) AS spent FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total * 1.5::DOUBLE - capped) / (w_total - spent) AS level FROM s2),
lv AS (SELECT first(level ORDER BY cap / w, source NULLS LAST) FILTER (WHERE level * w <= cap) AS lv FROM s3),
s AS (SELECT source, source_size, CAST(total AS BIGINT) AS total, least(cap, coalesce(lv * w, cap)) AS target FROM s3, lv),
q AS (SELECT *, greatest(1, CAST((total + 1048575) // 1048576 AS BIGINT)) AS block, CAST(floor(target + 0.5) AS BIGINT) AS words FROM s),
r AS (SELECT *, words // source_size AS passes, words % source_size AS remain, CAST(ceil(source_size / block) AS BIGINT) AS blocks FROM q WHERE source_size > 0),
qq AS (SELECT *, passes * blocks + CAST(ceil(remain / block) AS BIGINT) AS quota FROM r),
c AS (SELECT *, CAST(sum(quota) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(quota) OVER () AS BIGINT) AS slots FROM qq WHERE quota > 0),
n AS (SELECT CAST(floor(max(slots) * 1.01::DOUBLE) AS BIGINT) + 4096 AS points FROM c),
k AS (SELECT k, k * 0.6180339887498949::DOUBLE - floor(k * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(points)) AS k FROM n)),
h AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS rank FROM k JOIN c ON u >= (upto - quota)::DOUBLE / slots AND u < upto::DOUBLE / slots),
g AS (SELECT source, count(*) AS got FROM h GROUP BY source),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY (size = 0)::INT, ord, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
t AS (SELECT p.r, p.doc_id, p.size, p.source, s.source_size, s.target, CASE WHEN p.size > 0 THEN CAST(passes * p.size + greatest(0, least(p.size, remain - start)) AS BIGINT) ELSE 0 END AS taken, CAST(start // block AS BIGINT) AS b, points, got
      FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN qq ON p.source IS NOT DISTINCT FROM qq.source LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN n ON true)
SELECT t.doc_id, t.size, t.source_size, t.target, t.taken, CAST(CASE WHEN t.taken > 0 THEN coalesce(h.k, points + b) END AS BIGINT) AS first_slot
FROM t LEFT JOIN h ON t.source IS NOT DISTINCT FROM h.source AND t.b = h.rank
"""

_OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op3_mixing": _OP3, "op5_warc": _OP5}

"""The thin queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import repair_report
from .ecoc_langid import identify
from .exact_dedup import dedup_report
from .filter_audit import audit_documents
from .html_extract import extract
from .order_minhash import near_duplicates
from .packing import pack
from .quote_threads import as_mail, link_quotations
from .sentencepiece_backend import verified
from .suffix_dedup import dedup_report as suffix_report
from .support import table, tokenizer_file
from .token_sstable import round_trip
from .toxicity import score_documents
from .vafile_topk import top_k

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_tree_scored_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op3_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations have no quotes of their own, so their turns are first written as mails that quote each other."""
    return link_quotations(as_mail(table(spark, sf_dir, "conversations")), "conv_id", "turn")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op7_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_sentencepiece_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_BPE))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_tree_scored_html, op2_progressive_exact_dedup, op3_token_sstable, op4_quotation_linking, op5_order_minhash, op6_best_fit_packing, op7_vafile_topk, op8_boosted_toxicity, op9_ecoc_language_id, op10_sentencepiece_backend,
        op11_filter_interactions, op12_conversation_repair, op13_suffix_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_progressive_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
    "op4_quotation_linking": r"""
WITH turns AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
lines AS (
  SELECT conv_id, turn, md5(line) AS h, count(*) AS n
  FROM (SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS line FROM turns)
  WHERE line <> '' GROUP BY ALL
), said AS (SELECT conv_id, h, min(turn) AS first FROM lines GROUP BY ALL),
quoted AS (
  SELECT conv_id, turn + level AS turn, level, h, n FROM lines CROSS JOIN (VALUES (1), (2)) AS v(level)
  WHERE EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = lines.conv_id AND t.turn = lines.turn + level)
), found AS (
  SELECT q.conv_id, q.turn, level, n, CASE WHEN first < q.turn THEN first END AS first FROM quoted q LEFT JOIN said s ON s.conv_id = q.conv_id AND s.h = q.h
), counts AS (SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS n_quoted, CAST(coalesce(sum(n) FILTER (first IS NOT NULL), 0) AS BIGINT) AS n_linked FROM found GROUP BY ALL),
votes AS (SELECT conv_id, turn, first, sum(n) AS n FROM found WHERE level = 1 AND first IS NOT NULL GROUP BY ALL),
replies AS (SELECT conv_id, turn, arg_max(first, (n, first)) AS parent FROM votes GROUP BY ALL),
climb AS (
  SELECT conv_id, turn, turn AS above FROM turns
  UNION ALL SELECT c.conv_id, c.turn, r.parent FROM (SELECT * FROM climb) c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.above
), roots AS (SELECT conv_id, turn, min(above) AS root FROM climb GROUP BY ALL)
SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, parent, root, row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) AS position,
  coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
FROM turns JOIN roots USING (conv_id, turn) LEFT JOIN replies USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn)""".replace("WITH turns", "WITH RECURSIVE turns"),
    "op7_vafile_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_filter_interactions": r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
classes AS (
  SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM w JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = w.doc_id GROUP BY ALL
), f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT f1.l || f2.l || f3.l || f4.l || f5.l AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5
  WHERE len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5
), steps AS (SELECT filter_order, step, bits[step] AS b, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) AS s(step)),
counted AS (
  SELECT part, filter_order, step, b,
    sum(CASE WHEN fails & (before | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & b <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & b <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & b <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & b <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM classes CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM counted""",
    "op12_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), faulted AS (
  SELECT *, (4294967295 - list_reduce(
      flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(4294967295 AS BIGINT))) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM faulted WHERE fault <> 0
), ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
o AS (
  SELECT *, role[1:1] AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS kind, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM ordered
), moves(ini, edit, s, q, cost) AS (
  VALUES ('s', 'K', 0, 1, 0), ('u', 'K', 0, 2, 0), ('u', 'K', 1, 2, 0), ('u', 'K', 3, 2, 0), ('a', 'K', 2, 3, 0), (NULL, 'R', 0, 2, 2), (NULL, 'R', 1, 2, 2), (NULL, 'R', 2, 3, 2), (NULL, 'R', 3, 2, 2),
    (NULL, 'D', 0, 0, 3), (NULL, 'D', 1, 1, 3), (NULL, 'D', 2, 2, 3), (NULL, 'D', 3, 3, 3)
), inserts(s, q, cost, edits) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')
), walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS pos, q AS state, i.cost, i.edits AS audit FROM (SELECT DISTINCT conv_id FROM o) c, inserts i WHERE i.s = 0
  UNION ALL
  SELECT conv_id, pos, state, CAST(min(cost) AS INT), arg_min(audit, (cost, audit)) FROM (
    SELECT w.conv_id, o.pos, i.q AS state, w.cost + m.cost + i.cost + CASE WHEN o.kind = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END AS cost, w.audit || m.edit || i.edits AS audit
    FROM walk w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.pos = w.pos + 1
    JOIN moves m ON m.s = w.state AND (m.ini IS NULL OR m.ini = o.ini) AND (m.edit = 'D' OR o.kind IS NULL OR o.kind = 'truncated') JOIN inserts i ON i.s = m.q
  ) GROUP BY conv_id, pos, state
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM o GROUP BY conv_id
), best AS (
  SELECT c.conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n WHERE state IN (0, 3) GROUP BY c.conv_id
), letters AS (SELECT conv_id, i, audit[i:i] AS edit FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM best)),
placed AS (
  SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER before_here AS taken, sum(CAST(edit <> 'D' AS INT)) OVER before_here AS given FROM letters WINDOW before_here AS (PARTITION BY conv_id ORDER BY i)
), turns AS (
  SELECT p.conv_id, p.given, p.edit, o.role, CASE WHEN p.edit = 'I' THEN '' ELSE o.text END AS text, max(CAST(p.given = 1 AND p.edit = 'K' AND o.ini = 's' AS INT)) OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.pos = p.taken
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (given - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY given) AS whole FROM turns WHERE edit <> 'D' GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 199)) AS i, h FROM d WHERE length(h) >= 400),
windows AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS w FROM starts),
again AS (SELECT doc_id, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
runs AS (SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM (
    SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM again)
  ) GROUP BY doc_id, run),
spans AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last FROM runs GROUP BY doc_id),
pieces AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM runs),
heads AS (SELECT p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS head FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN heads USING (doc_id)""",
}

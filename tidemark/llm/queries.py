"""The registered corpus queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, html, lm, media, merkle, near_dedup, periodic_runs, quality, secrets, segmentation, suffix_dedup, token_counts
from tidemark.llm.common import LOWER, UPPER, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extracted(pages, html.trained(pages)).select("page_id", "url", "text", "n_chars")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.graded(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.NearDedup(width=3, percent=85).run(table(spark, sf_dir, "documents"))


def op7_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segmentation.decoded(segmentation.encoded(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "sample", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "log_prob", "perturbed", "inclusion", F.sha2("text", 256).alias("text_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.text_parts(chat.with_probe(spark, table(spark, sf_dir, "conversations")))
    return chat.turn_digests(chat.format_turns(turns))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(media.with_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.proved(table(spark, sf_dir, "documents"), proofs=False, tampered=altered)


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), altered=periodic_runs.loop_number())


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontamination": op5_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_sampled_segmentation": op7_sampled_segmentation,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_media_columns": op10_media_columns,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_secret_scans": op12_secret_scans,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(width: int) -> str:
    return f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END"


OP6_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest({_shingles(3)}) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN least ON a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

OP5_SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents), item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sets AS (SELECT DISTINCT doc_id, unnest({_shingles(5)}) AS s FROM words),
item_sets AS (SELECT DISTINCT item_id, unnest({_shingles(5)}) AS s FROM item_words WHERE len(w) >= 5),
short AS (SELECT DISTINCT item_id, len(w) AS m, array_to_string(w, ' ') AS s FROM item_words WHERE len(w) BETWEEN 1 AND 4),
spoken AS (SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s FROM words, (SELECT DISTINCT m FROM short) WHERE len(w) >= m),
sizes AS (SELECT item_id, count(*) AS n FROM item_sets GROUP BY item_id)
SELECT doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n)::DOUBLE AS containment
FROM sets JOIN item_sets USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0::DOUBLE FROM spoken JOIN short USING (m, s)
"""

#: CRC-32 of a decimal number, bit by bit
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))))"


def _leaf(text: str) -> str:
    told = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(told)})"


def _levels(name: str, count: int = 14) -> str:
    """CTEs of the levels of trees whose leaves are {name}0, all of them in {name}s."""
    up = [f"{name}{k + 1} AS (SELECT tree, level + 1 AS level, idx // 3 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, (n + 2) // 3 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, level, idx // 3, n)" for k in range(count)]
    every = " UNION ALL ".join(f"SELECT tree, level, idx, h, n FROM {name}{k}" for k in range(count + 1))
    return ",\n".join([*up, f"{name}s AS ({every})"])


def _sides(name: str) -> str:
    """CTE of what lies left and right of each node in its run."""
    side = lambda op: f"coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx {op} a.idx), '')"
    return f"{name}b AS (SELECT a.tree, a.level, a.idx, {side('<')} || '|' || {side('>')} AS beside FROM {name}s a JOIN {name}s b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx)"


OP11_SQL = f"""
WITH base AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents),
rowed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM base),
s0 AS (SELECT tree, 0 AS level, idx, leaf AS h, n FROM rowed),
{_levels('s')},
roots AS (SELECT tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS trees FROM ss WHERE n = 1),
t0 AS (SELECT 't' AS tree, 0 AS level, place AS idx, h, trees AS n FROM roots),
{_levels('t')},
{_sides('s')},
{_sides('t')},
steps AS (SELECT l AS level, (3 ** l)::BIGINT AS width FROM range(15) r(l)),
below AS (SELECT r.tree, r.idx, list(b.beside ORDER BY b.level) AS path FROM rowed r, steps JOIN sb b ON b.tree = r.tree AND b.level = steps.level AND b.idx = r.idx // width GROUP BY r.tree, r.idx),
beyond AS (SELECT r.name, list(b.beside ORDER BY b.level) AS path FROM roots r, steps JOIN tb b ON b.level = steps.level AND b.idx = r.place // width GROUP BY r.name),
paths AS (SELECT r.doc_id, r.leaf, coalesce(r.changed, r.leaf) AS offered, g.h AS subroot, list_concat(coalesce(b.path, []), coalesce(u.path, [])) AS path FROM rowed r JOIN roots g ON g.name = r.tree LEFT JOIN below b ON b.tree = r.tree AND b.idx = r.idx LEFT JOIN beyond u ON u.name = r.tree),
folds AS (SELECT *, list_reduce(list_concat([offered], path), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, (SELECT h FROM ts WHERE n = 1) AS root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM ts WHERE n = 1) AS verified FROM folds
"""


def _op12_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [*secrets.PATTERNS, *secrets.CLASSES]
    base, w = len(secrets.PATTERNS), secrets.WIDTH
    hits = []
    for k, p in enumerate(kinds):
        regex = quoted(p.regex if k < base else p.regex(w))
        group, least = (p.group, p.least) if k < base else (0, 0)
        hits.append(f"SELECT r, {k} AS kind, {least} AS least, unnest(regexp_split_to_array(t, {regex})) AS gap, unnest(regexp_extract_all(t, {regex}, 0)) AS hit, unnest(regexp_extract_all(t, {regex}, {group})) AS told, unnest(range(len(regexp_extract_all(t, {regex}, 0)))) AS k FROM docs WHERE regexp_matches(t, {regex})")
    allowed = " OR ".join(f"regexp_full_match(hit, {quoted(a)})" for a in secrets.ALLOWED)
    most = " ".join(f"WHEN {k} THEN {p.most(w)}" for k, p in enumerate(kinds) if k >= base)
    names = "[" + ", ".join(quoted(p.kind) for p in kinds) + "]"
    line = lambda where: f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER ({where}), '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(hits)}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY k) AS e FROM hits WHERE hit IS NOT NULL),
candidates AS (SELECT *, e - length(hit) AS s FROM placed WHERE kind >= {base} AND NOT ({allowed})),
windows AS (SELECT r, kind, s, p, substr(hit, p + 1, {w}) AS x FROM (SELECT *, unnest(range(length(hit) - {w - 1})) AS p FROM candidates)),
rich AS (SELECT * FROM windows WHERE list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: {secrets.count_weights(w)}[length(x) - length(replace(x, c, '')) + 1])) <= CASE kind {most} END),
fresh AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY r, kind, s ORDER BY p) <= {w} THEN 0 ELSE 1 END AS f FROM rich),
islands AS (SELECT *, sum(f) OVER (PARTITION BY r, kind, s ORDER BY p) AS island FROM fresh),
spans AS (SELECT r, kind, e - length(hit) AS s, e FROM placed WHERE kind < {base} AND length(told) >= least UNION ALL SELECT r, kind, s + min(p), s + max(p) + {w} FROM islands GROUP BY r, kind, s, island)
SELECT any_value(doc_id) AS doc_id, {', '.join(f'count(*) FILTER (kind = {k}) AS n_{p.kind}' for k, p in enumerate(secrets.PATTERNS))}, sha256({line(f'kind < {base}')}) AS base_sha256, {line('kind IS NOT NULL')} AS spans
FROM docs LEFT JOIN spans USING (r) GROUP BY r
"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": OP11_SQL,
    "op12_secret_scans": _op12_sql(),
    "op5_decontamination": OP5_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
}

"""The registered queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import chat, exact_dedup, hard_negatives, jaccard_join, media, mixing, multi_index, quality, secrets, sentencepiece_codec, spelling, substring_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_exact_dedup_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents")).drop("tag")


def op5_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), keep=["doc_id"], decoded=True)


def op6_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.prefix_examples(turns.unionByName(more)))


def op7_jaccard_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("row_key")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = media.write_archives(table(spark, sf_dir, "documents"))
    return media.media_features(media.read_archives(spark, uri)).drop("text")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard")


def op11_hard_negatives_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_nearest_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.corpus_words(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_structure": op1_secret_structure,
    "op2_exact_dedup_lsm": op2_exact_dedup_lsm,
    "op3_quality_cotraining": op3_quality_cotraining,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sentencepiece_unigram": op5_sentencepiece_unigram,
    "op6_chat_prefix_targets": op6_chat_prefix_targets,
    "op7_jaccard_bayes": op7_jaccard_bayes,
    "op8_token_counts": op8_token_counts,
    "op9_media_columns": op9_media_columns,
    "op10_mix_sources": op10_mix_sources,
    "op11_hard_negatives_gnat": op11_hard_negatives_gnat,
    "op12_nearest_multi_index": op12_nearest_multi_index,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup_lsm": """
WITH folded AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM folded
""",
    "op4_substring_dedup": r"""
WITH cut AS (
    SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?]+\s+|\n+') AS us, list_append(regexp_extract_all(coalesce(text, ''), '[.!?]+\s+|\n+'), '') AS ss FROM documents
), rows AS (
    SELECT doc_id, unnest(generate_series(1, len(us))) AS k, unnest(us) AS u, unnest(ss) AS s FROM cut
), placed AS (
    SELECT doc_id, k, u || regexp_extract(s, '^[.!?]+') AS raw,
        coalesce(sum(length(u) + length(s)) OVER before, 0) AS place,
        coalesce(sum(length(s) - length(replace(s, chr(10), ''))) OVER before, 0) AS line
    FROM rows WINDOW before AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sentences AS (
    SELECT doc_id, k, line, CAST(place + length(raw) - length(ltrim(raw, E' \t\n\r')) AS INTEGER) AS "start", length(trim(raw, E' \t\n\r')) AS n, regexp_split_to_array(lower(trim(raw, E' \t\n\r')), '\s+') AS words FROM placed
), atoms AS (
    SELECT doc_id, line, "start", "start" + n AS "end", len(words) AS n_words, rtrim(array_to_string(words, ' '), '.!?') AS plain,
        row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY k) AS upto
    FROM sentences WHERE n > 0
), runs AS (
    SELECT a.doc_id, a.i AS a, b.i AS b FROM atoms a ASOF JOIN atoms b ON a.doc_id = b.doc_id AND a.upto - a.n_words + 16 <= b.upto
    UNION SELECT b.doc_id, a.i, b.i FROM atoms b ASOF JOIN (SELECT doc_id, i, upto - n_words AS ahead FROM atoms) a ON a.doc_id = b.doc_id AND b.upto - 16 >= a.ahead
    UNION SELECT doc_id, min(i), max(i) FROM atoms GROUP BY doc_id, line HAVING sum(n_words) >= 8
), lists AS (
    SELECT doc_id, list(plain ORDER BY i) AS plains FROM atoms GROUP BY doc_id
), keyed AS (
    SELECT r.doc_id, x."start", CAST(y."end" AS INTEGER) AS "end", CAST(y.upto - x.upto + x.n_words AS INTEGER) AS n_words, array_to_string(plains[a:b], chr(10)) AS unit
    FROM runs r JOIN lists l ON r.doc_id = l.doc_id JOIN atoms x ON x.doc_id = r.doc_id AND x.i = r.a JOIN atoms y ON y.doc_id = r.doc_id AND y.i = r.b
), ranked AS (
    SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value("start") OVER w AS first_start, first_value("end") OVER w AS first_end, row_number() OVER w AS nth FROM keyed WINDOW w AS (PARTITION BY unit ORDER BY doc_id, "start")
)
SELECT doc_id, CASE WHEN doc_id = first_doc_id THEN greatest("start", first_end) ELSE "start" END AS "start", "end", n_words, first_doc_id, first_start FROM ranked WHERE nth > 1
""",
    "op6_chat_prefix_targets": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, role = 'assistant' AS target,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
        count(*) OVER (PARTITION BY conv_id) AS of_n,
        length(regexp_replace(replace(role || text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g'))
            + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars
    FROM turns
), summed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE target), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE target), '')) AS loss_sha256,
    CAST(sum(so_far) FILTER (WHERE target OR n = of_n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
""",
    "op7_jaccard_bayes": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents
), shingled AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM words
), sets AS (
    SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS set_id FROM shingled WHERE len(sh) > 0
), flat AS (
    SELECT doc_id, unnest(sh) AS g FROM shingled
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y, a.set_id <> b.set_id AS other, b.set_id FROM common c JOIN sets a ON x = a.doc_id JOIN sets b ON y = b.doc_id WHERE c.n >= 0.8 * (a.n + b.n - c.n) - 1e-9
), reached AS (
    SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reached r JOIN links l ON l.x = r.doc_id
), classes AS (
    SELECT doc_id, min(root) AS class_id, count(*) AS class_size FROM reached GROUP BY doc_id
), degrees AS (
    SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN other THEN set_id END) AS n_text_links FROM links GROUP BY x
)
SELECT c.doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links, c.doc_id = class_id AS kept FROM classes c LEFT JOIN degrees d ON c.doc_id = d.doc_id
""",
    "op11_hard_negatives_gnat": """
WITH fit AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows AS (
    SELECT vec_id, label, vec FROM fit QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, vec) = 1
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10
""",
    "op13_spelling_variants": """
WITH RECURSIVE tbl AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{7,}')) AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), bytes AS (
    SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM counted
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tbl
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), cut AS (
    SELECT DISTINCT word, n, length(word) AS l, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(m) AS top, arg_min(other, struct_pack(a := -m, b := other)) AS form FROM near GROUP BY word
), found AS (
    SELECT w.word, CASE WHEN top >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN top END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
    SELECT word, word AS root, form FROM found UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON c.form = f.word
)
SELECT f.word, f.form, c.root, n, n_near, form_n FROM found f JOIN chain c ON f.word = c.word WHERE c.form IS NULL
""",
}

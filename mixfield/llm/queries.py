"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixfield.llm import audio, language, lines, minhash, mixing, packing, phrases, ranking, simhash, substrings, toxicity, urls, vectors
from mixfield.llm.common import table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), ranks_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same result from strings of 50 words, with the smallest doc_id of each.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, generate_subscripts(words, 1) AS place, unnest(words) AS word FROM d
), r AS (
  SELECT doc_id, place, CASE WHEN count(*) OVER o = 50 THEN md5(string_agg(word, ' ') OVER o) END AS run
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), f AS (
  SELECT run, min(doc_id) AS least FROM r WHERE run IS NOT NULL GROUP BY run HAVING min(doc_id) < max(doc_id)
), l AS (
  SELECT r.doc_id, r.place, coalesce(f.least < r.doc_id, false) AS later FROM r LEFT JOIN f ON r.run = f.run
), k AS (
  SELECT w.doc_id, w.place, w.word, bool_or(l.later) OVER (PARTITION BY w.doc_id ORDER BY w.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM w JOIN l ON w.doc_id = l.doc_id AND w.place = l.place
)
SELECT d.doc_id, count(k.place) AS n_words, count(*) FILTER (WHERE k.gone) AS n_removed,
  sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.place) FILTER (WHERE NOT k.gone), '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(table(spark, sf_dir, "documents"), runs=True, of=lambda kept: F.sha2(kept.cast("binary"), 256))
    return found.select("doc_id", "n_lines", "n_removed", F.col("kept").alias("kept_sha256"), "longest_run")


#: The same result from strings of three lines: with the first occurrence of each, and with stretches of equal ones of two places.
OP6_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line, len(parts) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), w AS (
  SELECT doc_id, place, line, n,
    CASE WHEN place + 2 <= n THEN line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o END AS run
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) > 1 AND run IS NOT NULL AS later FROM w
), k AS (
  SELECT doc_id, place, line,
    later OR coalesce(lag(later, 1) OVER o, false) OR coalesce(lag(later, 2) OVER o, false) AS gone
  FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), p AS (
  SELECT a.doc_id, b.doc_id AS other, a.place - b.place AS shift, a.place
  FROM w a JOIN w b ON a.run = b.run AND (a.doc_id <> b.doc_id OR a.place <> b.place)
), s AS (
  SELECT doc_id, other, shift, place - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY place) AS stretch FROM p
), r AS (
  SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) + 2 AS n FROM s GROUP BY doc_id, other, shift, stretch) GROUP BY doc_id
)
SELECT d.doc_id,
  count(k.place) AS n_lines,
  count(*) FILTER (WHERE k.gone) AS n_removed,
  CASE WHEN any_value(d.text) IS NOT NULL
    THEN sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (WHERE NOT k.gone), '')) END AS kept_sha256,
  coalesce(any_value(r.n), 0) AS longest_run
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
GROUP BY d.doc_id
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(language.training_rows(docs)))
    return found.select("doc_id", F.coalesce(language.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = audio.load(audio.store(table(spark, sf_dir, "documents")))
    return files.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )


#: Only A-Z in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: The same result from all phrases of up to four words.
OP11_SQL = rf"""
WITH p AS (
  SELECT lang, d, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS text FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)
), w AS (
  SELECT lang, d, piece, generate_subscripts(words, 1) AS place, unnest(words) AS w1 FROM (SELECT lang, d, piece, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM p)
), g AS (
  SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER o AS w2, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o AS w3,
    w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY d, piece ORDER BY place)
), f AS (
  SELECT lang, phrase, size, count(*) AS a FROM (
    SELECT lang, w1 AS phrase, 1 AS size FROM g UNION ALL SELECT lang, w2, 2 FROM g UNION ALL SELECT lang, w3, 3 FROM g UNION ALL SELECT lang, w4, 4 FROM g)
  WHERE phrase IS NOT NULL GROUP BY lang, phrase, size HAVING count(*) >= 30
), c AS (
  SELECT f.lang, f.phrase, f.a, l.a AS l, r.a AS r, CAST(2000000 * CAST(f.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY f.lang, f.phrase ORDER BY 2000000 * CAST(f.a AS HUGEINT) // (l.a + r.a), k) AS first
  FROM (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS words FROM f WHERE size > 1) f
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.words[1:k], ' ') JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.words[k + 1:], ' ')
), inside AS (
  SELECT lang, array_to_string(words[k:k + n - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, size - n + 2)) AS k FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(2, size)) AS n FROM f WHERE size > 2))
  GROUP BY 1, 2
), n AS (
  SELECT lang, count(*) AS n FROM w GROUP BY lang
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, n.n, c.score
  FROM c JOIN n ON c.lang = n.lang LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE c.first = 1 AND NOT coalesce(100 * i.longer >= 80 * c.a, false)
)
SELECT * FROM ranked WHERE rank <= 2000
"""


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The same result from all pairs of documents with a shingle in common.
OP12_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, generate_subscripts(words, 1) AS place, unnest(words) AS w, len(words) AS n, words FROM (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents)
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN n < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[place:place + 3], ' ') END AS shingle
  FROM w WHERE place + 3 <= n OR (n < 4 AND place = 1)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN e ON r.doc_id = e.a
), c AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same result from scores of all documents.
OP13_SQL = rf"""
WITH t AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY 1, 2
), n AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id
), c AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n
), m AS (
  SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM n, c
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs
), q AS (
  SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, t.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN t ON q.term = t.term JOIN w ON w.term = t.term JOIN m ON m.doc_id = t.doc_id GROUP BY 1, 2
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_cost_packing, op3_toxicity, op4_source_mixing, op5_substring_dedup, op6_line_dedup, op7_url_filter, op8_vector_search, op9_language_id, op10_telephony_audio, op11_phrase_mining, op12_minhash_near_dedup, op13_ranked_search)}
ORACLE = {"op5_substring_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op11_phrase_mining": OP11_SQL, "op12_minhash_near_dedup": OP12_SQL, "op13_ranked_search": OP13_SQL}

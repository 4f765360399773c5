"""The operators as registered queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bpe, chat, collocations, common, fingerprints, lines, mixing, near, neighbours, pii, quality, ranking, sharding, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CONFLICT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", _CONFLICT), (-7, 1, "assistant", _CONFLICT)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    return chat.read_back(chat.format_chats(turns))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("kept", F.col("score") >= quality.THRESHOLD)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", mixing.shard_words(F.col("draws")).alias("shard_words"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ("ids_sha256", "decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.Scratch(spark, "tokens").path("files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, out).withColumnRenamed("id", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 8, grown=9).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.strip_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probe(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # a script beside the package, not a part of it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_mix_sources": op5_mix_sources,
    "op6_bpe": op6_bpe,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_collocations": op11_collocations,
    "op12_ranking": op12_ranking,
    "op13_pii": op13_pii,
    "pipeline": pipeline,
}

_ESCAPED = r"regexp_replace({0}, '(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])', '\1\4\\\2\5\3\6', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '{_CONFLICT}'), (-7, 1, 'assistant', '{_CONFLICT}'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
            CAST(sum(22 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op2_near_dedup": r"""
        WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM split WHERE len(words) > 0),
        shingle AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s FROM starts),
        size AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM shingle GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.r = a),
        least_ AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least_ USING (doc_id)""",
    "op9_line_dedup": f"""
        WITH split AS (SELECT doc_id, coalesce('=' || source, '') AS site, string_split(text, chr(10)) AS parts, md5(text) AS copy FROM documents),
        line AS (SELECT doc_id, site, copy, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS pos FROM split),
        trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM line),
        spread AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES} AND count(DISTINCT copy) >= {lines.MIN_SITES}),
        marked AS (SELECT *, line IN (SELECT line FROM spread) AS gone FROM trimmed),
        per AS (
            SELECT doc_id, CAST(count(*) FILTER (line <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
                coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
            length(CASE WHEN n_removed > 0 THEN kept ELSE text END) AS kept_chars,
            sha256(CASE WHEN n_removed > 0 THEN kept ELSE text END) AS text_sha256
        FROM documents d LEFT JOIN per USING (doc_id)""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
        grams AS (SELECT lang, words, i, unnest(range(1, least(4, len(words) - i + 1) + 1)) AS m FROM starts),
        f AS (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM starts GROUP BY lang),
        candidate AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE f >= 30 AND contains(phrase, ' ')),
        cut AS (SELECT *, unnest(range(1, len(words))) AS k FROM candidate),
        parts AS (
            SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
            FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : c.k], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.k + 1 :], ' ')),
        weakest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        held AS (
            SELECT DISTINCT c.lang, c.phrase FROM candidate c JOIN candidate o ON o.lang = c.lang AND len(o.words) > len(c.words)
                AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.a >= 80 * c.a)
        SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM weakest w JOIN total USING (lang) WHERE NOT EXISTS (FROM held h WHERE h.lang = w.lang AND h.phrase = w.phrase)
        QUALIFY rank <= 2000""",
    "op12_ranking": r"""
        WITH terms AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        docs AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM terms WHERE len(terms) > 0),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
        asked AS (
            SELECT item_id, term, count(*) AS qtf FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark) GROUP BY ALL),
        postings AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term),
        worth AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)) AS impact FROM postings, whole),
        scores AS (
            SELECT item_id, doc_id, row, CAST(sum(qtf * w * impact) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN worth USING (term) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}

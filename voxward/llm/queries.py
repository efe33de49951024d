"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.llm.collocations import PhraseParams, collocations
from voxward.llm.embeddings import CellParams, near_duplicates
from voxward.llm.licenses import LICENSES, scan_licenses
from voxward.llm.ngram_join import JaccardParams, jaccard_components
from voxward.llm.packing import PackParams, pack_documents
from voxward.llm.pieces import PieceParams, encode_pieces
from voxward.llm.pii import PiiParams, replace_pii
from voxward.llm.quality import judge
from voxward.llm.repeats import RepeatParams, remove_repeats
from voxward.llm.sharding import ShardParams, shard_documents
from voxward.llm.tables import table
from voxward.llm.token_files import TokenFileParams, read_tokens, write_tokens
from voxward.llm.warc import read_warc, responses, write_derivatives
from voxward.llm.whitening import WhitenParams, whiten
from voxward.session import delete_at_end, shared_folder


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), JaccardParams(width=4, percent=85))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept"
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), PackParams(capacity=1024, end_id=2, words_kept=400_000))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the new text and how many entities of which kind were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PiiParams(), keep_entities=True).select(
        "doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), F.array_sort(F.array_distinct("entities.kind")).alias("kinds")
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), PieceParams(), keep_ids=False)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page what its two derived records say, read back from the files."""
    pages = responses(table(spark, sf_dir, "pages"))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    manifest = write_derivatives(pages, folder)
    # Both sides grow with the pages, which the planner can't see in what is read from files.
    read = read_warc(manifest, keep_block=False).hint("merge")
    # Repeated pages share an identifier; each of their records comes back once.
    return pages.select("page_id", F.col("record_id").alias("refers_to")).distinct().join(read, "refers_to")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, TokenFileParams(end_id=2, words_kept=400_000))
    return read_tokens(manifest, keep_ids=False)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, RepeatParams(window=100), keep_text=False)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), CellParams(cosine=0.93))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"), PhraseParams(min_count=10, covered=50, top=2000, max_words=3))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components per vector; a deviation that no long can hold is NULL."""
    found = whiten(table(spark, sf_dir, "embeddings"), WhitenParams(components=8))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes, equal texts together."""
    return shard_documents(table(spark, sf_dir, "documents"), ShardParams(shards=24, extra=8))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_license_scan": op2_license_scan,
    "op3_host_rules": op3_host_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_token_files": op8_token_files,
    "op9_suffix_array": op9_suffix_array,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_collocations": op11_collocations,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_sharding": op13_sharding,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The limits of QualityParams, written out: rules, prior between 2 and 1000 documents, host limit one half.
_QUALITY = rf"""
        w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        l AS (
            SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
        ), t AS (
            SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'g': array_to_string(words[i:i + 2], ' '), 'pos': i}})) AS t
            FROM w
        ), g AS (SELECT doc_id, t.g AS g FROM t GROUP BY 1, 2 HAVING count(*) > 1),
        r AS (
            SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
            FROM (SELECT t.doc_id, unnest([t.t.pos, t.t.pos + 1, t.t.pos + 2]) AS pos FROM t JOIN g ON g.doc_id = t.doc_id AND g.g = t.t.g)
            GROUP BY doc_id
        ), m AS (
            SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM l LEFT JOIN r USING (doc_id)
        ), f AS (
            SELECT doc_id, source, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
                100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines,
                word_chars < 3 * n_words OR word_chars > 12 * n_words AS word_length FROM m
        ), h AS (
            SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k
            FROM (UNPIVOT (SELECT source, short, repeats, symbols, dup_lines, word_length FROM f)
                  ON short, repeats, symbols, dup_lines, word_length INTO NAME rule VALUE failed)
            GROUP BY ALL
        ), p AS (
            SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS variance FROM h GROUP BY rule
        ), q AS (
            SELECT rule, mean, least(greatest(CASE WHEN variance > 1e-12 THEN mean * (1 - mean) / variance - 1 ELSE 1000 END, 2), 1000) AS weight
            FROM p
        ), bad AS (SELECT DISTINCT source FROM h JOIN q USING (rule) WHERE (k + mean * weight) / (n + weight) > 0.5),
        judged AS (
            SELECT m.*, f.short OR f.repeats AS base_failed, bad.source IS NOT NULL AS host_rejected
            FROM m JOIN f USING (doc_id) LEFT JOIN bad ON bad.source = m.source
        )"""

_HINT = "licen[sc]e|permission|redistribut|public domain"
_SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil ", "fulfill "), ("judgement", "judgment"),
    ("per cent", "percent"), ("programme", "program"), ("utilisation", "utilization"), ("whilst", "while"), ("https", "http"),
    ("merchantibility", "merchantability"), (r"\bv\. ?(\d)", r"version \1"),
)


def _canonical(text: str) -> str:
    """SQL for the canonical form of a licence text."""
    form = rf"regexp_replace(lower({text}), '(?m)^\W*(?:copyright|©|\(c\))\W.*$|all rights reserved\.?', ' ', 'g')"
    for other, one in _SPELLINGS:
        form = f"regexp_replace({form}, '{other}', '{one}', 'g')"
    return rf"trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _texts(rows: tuple[tuple[str, str], ...]) -> str:
    quoted = (", ".join("'" + v.replace("'", "''") + "'" for v in row) for row in rows)
    return ", ".join(f"({row})" for row in quoted)


ORACLE_SQL = {
    "op2_license_scan": f"""
        WITH k AS (
            SELECT {_canonical("text")} AS form, min(license) AS license FROM (VALUES {_texts(LICENSES)}) t(license, text) GROUP BY 1
        ), d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(lower(text), '{_HINT}')),
        u AS (
            SELECT doc_id, false AS whole, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(lower(line), '{_HINT}')
            UNION ALL
            SELECT doc_id, true, text FROM d
        ), f AS (
            SELECT doc_id, count(*) FILTER (NOT whole) AS n_notices,
                array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, min(license) FILTER (whole) AS whole_license
            FROM (SELECT doc_id, whole, {_canonical("text")} AS form FROM u) JOIN k USING (form) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(licenses, '') AS licenses, whole_license
        FROM documents LEFT JOIN f USING (doc_id)
    """,
    "op3_host_rules": f"""
        WITH {_QUALITY}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
            NOT base_failed AND NOT host_rejected AS kept
        FROM judged
    """,
    "op1_ngram_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingle
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * common >= 85 * (x.n + y.n - common)
        ), reach AS (
            SELECT a AS node, b AS other FROM links
            UNION
            SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
        ), low AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.other, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d.doc_id
    """,
    "op11_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
        t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, 1 AS k, unnest(words) AS phrase FROM w
            UNION ALL
            SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))) FROM w
            UNION ALL
            SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) FROM w
        ), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
        cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
        parts AS (
            SELECT *, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:k], ' ') AS rest FROM cuts
        ), scored AS (
            SELECT parts.lang, parts.phrase, parts.a, cut, x.a AS l, y.a AS r,
                ((1000000::HUGEINT * parts.a * parts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = head JOIN f y ON y.lang = parts.lang AND y.phrase = rest
        ), lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
        ), inner_ AS (
            SELECT lang, array_to_string(words[1:2], ' ') AS phrase, a FROM c WHERE k = 3
            UNION ALL
            SELECT lang, array_to_string(words[2:3], ' '), a FROM c WHERE k = 3
        ), longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
        kept AS (
            SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase)
            WHERE place = 1 AND (most IS NULL OR 100 * most < 50 * lowest.a)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
    """,
}

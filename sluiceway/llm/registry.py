"""One query per operator, over its whole table, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import bpe, infill, language, licenses, neighbours, packing, pages, phrases, pii, rules, simhash
from sluiceway.llm import toxicity, winnowing
from sluiceway.llm.common import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", bpe.round_trip(F.col("text"), BYTE_VOCABULARY).alias("b")).select(
        "doc_id", "b.*"
    )


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """The personal data in every document."""
    found = pii.personal_data(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.FORMS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0)


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), WORD_VOCABULARY)


def op5_factorization(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """The licenses in every document."""
    found = licenses.scan(table(spark, folder, "documents"))
    each = F.transform(
        "licenses", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], F.format_number(m["coverage"], 4))
    )
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.sort_array(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.array_join(each, ",").alias("matches"),
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return language.languages(table(spark, folder, "documents"))


def op8_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, folder, "pages"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document and whether it is kept."""
    judged = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept", "rule")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of an edited copy, whose second half is the beginning of the next document."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = winnowing.with_fingerprint(winnowing.dealt_by_order(docs, "doc_id"))
    followed = winnowing.with_next(own, ["text", "fingerprint"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next.text", half))
    edits = followed.select(
        "doc_id",
        size.cast("bigint").alias("n_chars"),
        "fingerprint",
        winnowing.likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
        edited.alias("edited"),
    )
    both = winnowing.with_fingerprint(edits, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest(F.col("fingerprint")).alias("fingerprint"),
        winnowing.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        "near_next",
    )


def op12_skip_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written out for filling in its middle, and joined again."""
    docs = table(spark, folder, "documents")
    made = infill.round_trip(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", made.alias("cut")).select("doc_id", "cut.*")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language whose words keep together most."""
    return phrases.collocations(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for name, make in globals().items() if name.startswith("op")}


def sql() -> dict[str, str]:
    """What plain SQL can say of these operators; the others are tested against plain Python."""
    return {
        "op3_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
              sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
              WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
              list_inner_product(q.e, c.e) / (q.n * c.n) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
            SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER
              AS rank, vec_id, score FROM pairs QUALIFY rank <= 5""",
        "op12_skip_list": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
              regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
              sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
            h AS (SELECT *, len(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
              ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
            p AS (SELECT *, array_to_string(t[1:low], '') AS a, array_to_string(t[low + 1:high], '') AS b,
              array_to_string(t[high + 1:], '') AS z FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
              CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
              sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b
                ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256,
              sha256(text) AS restored_sha256 FROM p""",
        "op13_collocations": r"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
            n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
            g AS (SELECT lang, m, unnest(list_transform(range(1, (len(w) - m + 2)::BIGINT),
              lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
            f AS (SELECT lang, m, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
            c AS (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE m > 1),
            k AS (SELECT c.*, i, array_to_string(x[1:i], ' ') AS one, array_to_string(x[i + 1:], ' ') AS two
              FROM c, (SELECT unnest([1, 2, 3]) AS i) WHERE i < m),
            s AS (SELECT k.lang, k.phrase, k.a, k.m, k.i, u.a AS l, v.a AS r,
              ((2000000 * k.a::HUGEINT) // (u.a + v.a))::BIGINT AS score FROM k JOIN f u ON u.lang = k.lang
              AND u.phrase = k.one JOIN f v ON v.lang = k.lang AND v.phrase = k.two
              QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.i) = 1),
            b AS (SELECT DISTINCT c.lang, array_to_string(c.x[o:o + z - 1], ' ') AS phrase, c.a AS longer
              FROM c, (SELECT unnest([2, 3]) AS z), (SELECT unnest([1, 2, 3]) AS o)
              WHERE z < m AND o + z - 1 <= m),
            kept AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.lang = s.lang
              AND b.phrase = s.phrase AND 100 * b.longer::HUGEINT >= 80 * s.a::HUGEINT))
            SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC,
              encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
    }

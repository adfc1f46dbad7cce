"""The operators of this subpackage as registered queries, next to SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.llm.ann_search import approximate_top_k
from lodgeframe.llm.byte_bpe import encode
from lodgeframe.llm.collocations import top_collocations
from lodgeframe.llm.common import held_out, read, written
from lodgeframe.llm.exact_search import exact_top_k, scaled, usable
from lodgeframe.llm.language import identify, learn_languages
from lodgeframe.llm.licences import scan_licences
from lodgeframe.llm.merkle import leaf, verified_rows
from lodgeframe.llm.packing import pack, token_pieces
from lodgeframe.llm.pii import KINDS, find_pii, iban_pattern
from lodgeframe.llm.quality import learn_quality, quality_score
from lodgeframe.llm.sharding import shard_documents
from lodgeframe.llm.simhash import near_duplicates
from lodgeframe.llm.unit_dedup import remove_repeats


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and runs of whole sentences of 50 words or more. Spans are listed as start-stop, in characters of the
    original text. Sentences that runs are made of are beyond SQL, so a test holds this against brute force."""
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["stop"]))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, min_words=50, passage=50).select(
        "doc_id",
        "text",
        F.size("removed_spans").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits are listed as licence@start-stop."""
    hit = lambda h: F.concat(h["licence"], F.lit("@"), h["start"], F.lit("-"), h["stop"])
    return scan_licences(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentences"),
        F.array_join(F.array_distinct(F.transform("hits", lambda h: h["licence"])), ",").alias("licences"),
        F.array_join(F.transform("hits", hit), ",").alias("hits"),
    )


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )
    return approximate_top_k(rows, rows.where(F.col("id") % 20 == 0), k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096
    )
    narrow = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(written(narrow, "pieces"), capacity=4096)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 5, 0)
    model = learn_quality(docs, read(spark, sf_dir, "labels"), ~apart)
    scored = docs.select(
        "doc_id", apart.alias("held_out"), quality_score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    rows = vectors.select(
        F.col("vec_id").alias("id"), scaled(F.col("embedding"), 256).alias("vector")
    )
    return exact_top_k(rows, rows.where(F.col("id") % 50 == 0), k=5)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 4, 2)
    model = learn_languages(docs, ~apart)
    found = docs.select("doc_id", apart.alias("held_out"), identify(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents")
    encoded = encode(docs, path, public_tokenizers.PATTERN, with_bytes=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are listed as kind:start:stop; ``scores`` are those of all spans, in the same order."""
    base = [k.name for k in KINDS if k.base]
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    listed = lambda spans: F.array_join(F.transform(spans, shown), ",")
    found = find_pii(read(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of_kind(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(read(spark, sf_dir, "documents"))


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
), phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM split, range(1, 6) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS starts(i)
), counted AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM phrases GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counted WHERE k > 1 AND f >= 100
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o
    WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.f >= 100 * c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, cut, 1000 * c.f * n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
    JOIN totals USING (lang)
    JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:cut], ' ')
    JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= 2000
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides crc32 of the id, the proof is checked against the row with one more in ``n_chars``."""
    docs = read(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    values = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]
    return verified_rows(docs, fields, "lang", "doc_id", F.when(changed, leaf(*values)))


def _pii_sql() -> str:
    """The plain patterns, found by splitting the text at their matches; the same tests on what they match."""
    around = "(SELECT substr(t, greatest(a - 40, 0) + 1, least(a, 40)) || chr(10) || substr(t, b + 1, 40))"
    near = lambda words: (
        f"regexp_matches(translate({around}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\b(?:{words})\\b')"
    )
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    account = "replace(m, ' ', '')"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({digits})), lambda i: CASE"
        f" WHEN i % 2 = 0 THEN CAST(substr(reverse({digits}), i + 1, 1) AS INT)"
        f" ELSE 2 * CAST(substr(reverse({digits}), i + 1, 1) AS INT) - CASE WHEN substr(reverse({digits}), i + 1, 1) >= '5'"
        " THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_transform(string_split(substr({account}, 5) || left({account}, 4), ''), lambda c:"
        " CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),"
        " lambda r, d: CASE WHEN d > 9 THEN (r * 100 + d) % 97 ELSE (r * 10 + d) % 97 END, 0) = 1",
        "ssn": "m[:3] NOT IN ('000', '666') AND m[:3] < '900' AND m[5:6] <> '00' AND m[8:] <> '0000'",
        "local_phone": "true",
    }
    # as the kinds are defined, not as the operator searches for them
    plain = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
        "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)",
        "card": "[0-9](?:[ -]?[0-9])+",
        "phone": "\\+[0-9][ ().0-9-]+[0-9]",
        "iban": iban_pattern(),
        "ssn": "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b",
        "local_phone": "\\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\\b",
    }
    parts = [
        f"""
  SELECT doc_id, row, {number} AS place, '{k.name}' AS kind, {str(k.base).lower()} AS base, a, b,
         {k.points} + CASE WHEN {near(k.words)} THEN {k.gain} ELSE 0 END AS score
  FROM (
    SELECT *, CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + list_sum(list_transform(list_prepend('', found[:i - 1]), lambda g: length(g))) AS BIGINT) AS a,
           a + length(m) AS b
    FROM (SELECT *, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT *, string_split_regex(t, '{plain[k.name]}') AS gaps, regexp_extract_all(t, '{plain[k.name]}') AS found FROM texts))
  ) WHERE {valid[k.name]}"""
        for number, k in enumerate(KINDS)
    ]
    return f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents
), spans AS ({" UNION ALL ".join(parts)}
), kept AS (
  SELECT *, kind || ':' || a || ':' || b AS span FROM spans s
  WHERE score >= 60 AND (base OR NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.row = s.row AND o.base AND o.a < s.b AND s.a < o.b))
)
SELECT texts.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY place, a) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY place, a), '') AS spans,
       coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY place, a), '') AS scores
FROM texts LEFT JOIN kept USING (row) GROUP BY texts.row, texts.doc_id
"""


OP13_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, n_chars,
         list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END, 4294967295) AS crc,
         list_transform([CAST(doc_id AS VARCHAR), source, lang], lambda f: coalesce(CAST(strlen(f) AS VARCHAR) || ':' || f, '-')) AS head,
         coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-') AS tail
  FROM documents
), hashed AS (
  SELECT doc_id, tree, xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS changed,
         sha256(head[1] || head[2] || head[3] || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head[1] || head[2] || head[3] || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other
  FROM sized
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
), nodes(tree, level, p, h, n) AS (
  SELECT tree, 0, p, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, level, p // 2, n
), subroots AS (
  SELECT tree, h, level AS height, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper(level, p, h, n) AS (
  SELECT 0, p, h, n FROM subroots
  UNION ALL
  SELECT level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, p // 2, n
), up AS (
  SELECT tree, level, p, h FROM nodes WHERE n > 1
  UNION ALL
  SELECT tree, height + upper.level, upper.p, upper.h
  FROM subroots CROSS JOIN upper WHERE upper.level > 0 OR upper.p <> subroots.p
), walk(tree, leaf_p, level, p, h, proof) AS (
  SELECT tree, p, 0, p, CASE WHEN changed THEN other ELSE leaf END, '' FROM leaves
  UNION ALL
  SELECT w.tree, w.leaf_p, w.level + 1,
         CASE WHEN w.level + 1 = s.height THEN s.p ELSE w.p // 2 END,
         sha256(CASE WHEN o.h IS NULL THEN w.h WHEN o.p < w.p THEN o.h || w.h ELSE w.h || o.h END),
         w.proof || coalesce(o.h, '')
  FROM walk w JOIN subroots s ON s.tree = w.tree
    LEFT JOIN up o ON o.tree = w.tree AND o.level = w.level AND o.p = xor(w.p, 1)
  WHERE w.level < s.height + (SELECT max(level) FROM upper)
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN upper r ON r.n = 1
  JOIN walk w ON w.tree = l.tree AND w.leaf_p = l.p AND w.level = s.height + r.level
"""


OP8_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash": op2_simhash,
        "op3_licences": op3_licences,
        "op4_ann_search": op4_ann_search,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_sharding": op7_sharding,
        "op8_exact_search": op8_exact_search,
        "op9_language": op9_language,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_pii": op11_pii,
        "op12_collocations": op12_collocations,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_search": OP8_SQL,
        "op11_pii": _pii_sql(),
        "op12_collocations": OP12_SQL,
        "op13_merkle": OP13_SQL,
    }

"""The registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    from . import packing

    return packing.pack(packing.cut_documents(table(spark, d, "documents"), tokenizer_path()))


QUERIES["op1_packing"] = op1_packing


def op2_secrets(spark: SparkSession, d: str) -> DataFrame:
    from . import secrets

    docs = table(spark, d, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs)).select("doc_id", "findings")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("findings", lambda x: x["kind"] != "grammar")), 256).alias("base_sha256"), joined("findings").alias("spans"), count("grammar"),
    )


QUERIES["op2_secrets"] = op2_secrets


def op4_extraction(spark: SparkSession, d: str) -> DataFrame:
    from . import extraction

    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op4_extraction"] = op4_extraction


def op8_language(spark: SparkSession, d: str) -> DataFrame:
    from . import language

    docs = table(spark, d, "documents").select("doc_id", "text", "lang", (language.remainder("doc_id") == 0).alias("held_out"))
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model, ["doc_id", "held_out"])


QUERIES["op8_language"] = op8_language


TOXIC_AT = 0.25


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, d, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, d, "labels"), ["quality", "toxic"])
    return toxicity.score(docs, chain, ["doc_id"]).withColumn("toxic", F.col("toxic_score") >= TOXIC_AT)


QUERIES["op9_toxicity"] = op9_toxicity


def op7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES["op7_neighbours"] = op7_neighbours


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    from . import decontamination

    found = decontamination.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 9).alias("similarity"))


QUERIES["op10_decontamination"] = op10_decontamination
ORACLES["op10_decontamination"] = r"""
WITH iw AS (SELECT item_id, [x for x in regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+') if x <> ''] w FROM benchmark),
i AS (SELECT item_id, s, count(*) n FROM (SELECT item_id, unnest([array_to_string(w[k:k+4], ' ') for k in range(1, greatest(len(w) - 3, 2))]) s FROM iw WHERE len(w) > 0) GROUP BY ALL),
t AS (SELECT item_id, sum(n) total FROM i GROUP BY 1),
dw AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+') if x <> ''] w FROM documents),
d AS (SELECT doc_id, s, count(*) n FROM (SELECT doc_id, unnest([array_to_string(w[k:k+4], ' ') for k in range(1, greatest(len(w) - 3, 2))]) s FROM dw WHERE len(w) > 0) GROUP BY ALL)
SELECT doc_id, item_id, round(sum(least(d.n, i.n)) / any_value(total), 9) AS similarity
FROM d JOIN i USING (s) JOIN t USING (item_id) GROUP BY doc_id, item_id HAVING sum(least(d.n, i.n)) >= 0.8 * any_value(total)
"""


def op3_licenses(spark: SparkSession, d: str) -> DataFrame:
    from . import licenses

    found = licenses.scan(table(spark, d, "documents"), licenses.templates(spark))
    return found.select(F.col("id").alias("doc_id"), F.col("license").alias("license_id"), F.round("containment", 9).alias("containment"))


def _license_sql() -> str:
    from .licenses import TEMPLATES

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    return rf"""
WITH l(license_id, text) AS (VALUES {rows}),
lw AS (SELECT license_id, [x for x in regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+') if x <> ''] w FROM l),
i AS (SELECT DISTINCT license_id, unnest([array_to_string(w[k:k+4], ' ') for k in range(1, len(w) - 3)]) s FROM lw),
t AS (SELECT license_id, count(*) total FROM i GROUP BY 1),
dw AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+') if x <> ''] w FROM documents),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k+4], ' ') for k in range(1, len(w) - 3)]) s FROM dw)
SELECT doc_id, license_id, round(count(*) / any_value(total), 9) AS containment
FROM d JOIN i USING (s) JOIN t USING (license_id) GROUP BY doc_id, license_id HAVING count(*) >= 0.8 * any_value(total)
"""


QUERIES["op3_licenses"] = op3_licenses
ORACLES["op3_licenses"] = _license_sql()


def op5_jaccard(spark: SparkSession, d: str) -> DataFrame:
    from . import similarity

    return similarity.join(table(spark, d, "documents")).drop("row_key", "class_key")


QUERIES["op5_jaccard"] = op5_jaccard
ORACLES["op5_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k+4], ' ') for k in range(1, greatest(len(w) - 3, 2))]) s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op6_lm(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from . import lm

    docs = table(spark, d, "documents").select("doc_id", "text", lm.held_out("doc_id").alias("held_out"))
    train = docs.where(~F.col("held_out"))
    counts = lm.word_counts(train)
    model = lm.fit(train, public_tokenizers.path("byte_bpe_50k.tiktoken"), counts=counts)
    return lm.score(docs, train, model, ["doc_id", "held_out"], counts=counts)


QUERIES["op6_lm"] = op6_lm


def op11_sharding(spark: SparkSession, d: str) -> DataFrame:
    from . import sharding

    return sharding.assign(table(spark, d, "documents"))


QUERIES["op11_sharding"] = op11_sharding
# 64-bit arithmetic is done in 128 bits and cut; the checksum runs over the bytes with a table of the reflected polynomial
ORACLES["op11_sharding"] = r"""
WITH RECURSIVE bits(b, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows_ AS (SELECT doc_id, size::BIGINT AS size, CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) END AS text_crc32 FROM raw, tab),
ids AS (SELECT DISTINCT coalesce(doc_id, -1) AS id FROM documents),
m1 AS (SELECT id, ((id::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS x FROM ids),
m2 AS (SELECT id, (xor(x, x >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM m1),
m3 AS (SELECT id, (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM m2),
k AS (SELECT id, xor(x, x >> 31) AS key FROM m3),
walk(id, state, b, j) AS (SELECT id, key, -1::BIGINT, 0::BIGINT FROM k UNION ALL
  SELECT id, s, j, trunc((j + 1) * (2147483648::DOUBLE / ((s >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT id, j, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS s FROM walk WHERE j < 17)),
placed AS (SELECT id, max(b) FILTER (b < 16)::INT AS shard, max(b)::INT AS grown_shard FROM walk GROUP BY id)
SELECT r.doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY key, r.doc_id NULLS LAST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM rows_ r JOIN k ON k.id = coalesce(r.doc_id, -1) JOIN placed p ON p.id = k.id
"""


def op12_ranking(spark: SparkSession, d: str) -> DataFrame:
    from . import ranking

    return ranking.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES["op12_ranking"] = op12_ranking
ORACLES["op12_ranking"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM t WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
h AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM h, g GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * docs) // total AS m FROM t, g),
s AS (SELECT item_id, r, sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM h JOIN i USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
FROM s JOIN t USING (r) WHERE score > 0) WHERE rank <= 50
"""


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from . import alignment

    return alignment.align(table(spark, d, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op13_alignment"] = op13_alignment

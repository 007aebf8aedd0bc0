"""Registered queries of the training-data operators and the SQL that they must agree with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from shelfcast.llm import alignment as al
from shelfcast.llm.chat import format_chats, read_back
from shelfcast.llm.common import bucket_of, materialize, table
from shelfcast.llm.decontaminate import judged
from shelfcast.llm.language_model import score_documents
from shelfcast.llm.lexical_search import rank
from shelfcast.llm.linededup import dedup_lines
from shelfcast.llm.mixing import mix
from shelfcast.llm.neardup import near_duplicates
from shelfcast.llm.quality_gam import fit_quality, score_quality
from shelfcast.llm.quality_rules import fit_rules, judge
from shelfcast.llm.substrings import remove_repeats
from shelfcast.llm.textstats import COUNTS
from shelfcast.llm.token_files import WordTokenizer, read_sums, write_tokens
from shelfcast.llm.toxicity import fit_toxicity, score_toxicity
from shelfcast.session import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


OP9_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM lowered),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b
       WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM bw),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM pos),
hit AS (SELECT rid, i, dw.m, item FROM dw JOIN win ON dw.m = win.m AND dw.p = win.p),
words AS (SELECT rid, count(DISTINCT j) AS n_hit
          FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


@query(OP9_SQL)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, names = judged(docs, table(spark, sf_dir, "benchmark"))
    items = F.col(names["items"])
    return out.select(
        "doc_id",
        F.col(names["n_words"]).alias("n_words"),
        F.col(names["n_hit"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        F.col(names["contaminated"]).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15)
                       AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) AS position FROM d GROUP BY source),
w AS (SELECT *, (position - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS fill, cap / weight AS ratio,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total
      FROM w WINDOW o AS (ORDER BY cap / weight, position)),
l AS (SELECT min_by((total - capped) / open, fill) AS level FROM f
      WHERE (total - capped) / open * weight <= cap),
t AS (SELECT source, source_size, least(CAST(weight * level AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM f, l),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source
                  ORDER BY key, CAST(doc_id AS VARCHAR) NULLS FIRST, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size
            + greatest(least(start + size, quota % source_size) - start, 0) END AS BIGINT) AS taken
FROM p"""


@query(OP5_SQL)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    out, names = judge(docs, rules)
    return out.select("doc_id", *[F.col(names[n]).alias(n) for n in (*COUNTS, "base_failed", "kept", "rule")])


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=bucket_of("doc_id", 5) != 0)
    out, score = score_quality(docs, model)
    return out.select(
        "doc_id",
        (bucket_of("doc_id", 5) == 0).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.3).cast("int").alias("predicted"),
    )


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train=bucket_of("doc_id", 4) != 2)
    out, score = score_toxicity(docs, model)
    return out.select(
        "doc_id",
        (bucket_of("doc_id", 4) == 2).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.3).cast("int").alias("predicted"),
    )


@query()
def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=4).withColumnRenamed("id", "doc_id")


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped, and the digest of the remaining text."""
    out, names = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_exact=1)
    return out.select(
        "doc_id",
        F.col(names["n_lines"]).alias("n_lines"),
        F.col(names["n_dropped"]).alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col(names["removed"])
    return out.select(
        "doc_id",
        F.col(names["n_bytes"]).alias("n_bytes"),
        (F.col(names["n_bytes"]) - F.length(names["kept"])).cast("long").alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"),
        F.sha2(F.col(names["kept"]), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS r,
             regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS t FROM c),
o AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
             sum(length('<s>[INST]  [/INST]</s>') + length(r) + length(t)) AS n FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM o"""


@query(OP2_SQL)
def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], chats.schema)
    nodes, segs, members = format_chats(chats.unionByName(probe))
    whole = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    digests = read_back(nodes, segs).select(
        "leaf",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    found = members.join(materialize(digests, "chat-digests"), "leaf")
    return found.drop("leaf").withColumnRenamed("conv", "conv_id")


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of("doc_id", 7) == 2
    scored = score_documents(docs, ~held_out)
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", held_out.alias("held_out"), *columns)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
items AS (SELECT DISTINCT item_id, term FROM b),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM df, totals),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * CAST(len(w) AS BIGINT) * n_docs) // n_words) AS m FROM d, totals WHERE len(w) > 0),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM items JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 50"""


@query(OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> al.ByteLevel:
    return al.ByteLevel(tokenizer_file("byte_bpe_50k.json"))


def pieces() -> al.Pieces:
    return al.Pieces(tokenizer_file("piece_bpe_32k.model"))


#: Columns that ``op12`` makes of an alignment inside the task; ``links`` is only needed until the counts are known.
ALIGNED = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
ALIGNED += [StructField("groups_sha256", StringType()), StructField("links", BinaryType())]


def digest_view(aligner: al.Aligner):
    sizes = [len(side.sizes) for side in aligner.sides]
    rows = al.digits(max(sizes))

    def view(found: al.Aligned):
        doc = found.a.doc[found.over_a][found.linked]
        links = found.per_doc(doc)
        texts = al.group_texts(found, rows)
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
        counts = (found.per_doc(found.a.doc), found.per_doc(found.b.doc), links, links)
        return [*map(pa.array, counts), pa.array(digests), pa.array(al.link_lists(found, *sizes), pa.binary())]

    return view


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are never empty, so each shared end has one link and closes one group."""
    docs = table(spark, sf_dir, "documents")
    out, names = al.align(docs, byte_level, pieces, digest_view, ALIGNED, keep=["doc_id"])
    out = materialize(out, "aligned")
    vocabularies = byte_level().tokens, pieces().tokens
    counts = al.pair_counts(out, names["links"])
    return al.rate_links(out, names["links"], counts, len(vocabularies[1]), al.linkable(*vocabularies))[0]


def word_tokenizer() -> WordTokenizer:
    return WordTokenizer(tokenizer_file("word_bpe_49k.json"))


@query()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), word_tokenizer, 2, fresh_folder(spark, "token-files"))
    return read_sums(spark, path).withColumnRenamed("doc", "doc_id")

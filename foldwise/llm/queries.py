"""One query per operator over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import best_fit_packing, chat, embedding_caps, exact_dedup, jaccard_pivots, kneser_ney, language_crf, lm_trie, mixing, periodic_runs, pii_weak, prefix_trie, sentencepiece_codec
from foldwise.llm.common import load
from foldwise.llm.registry import QUERIES, SQL, query  # noqa: F401


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, folder, "documents")).drop("n_chunks")


ADDED_CONVERSATION = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


@query(
    "op3_chat_prefix_targets",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
        SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
               sum(length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
                   + CASE WHEN regexp_full_match(role, '[a-z]+') THEN length(role) ELSE 1 + 2 * strlen(role) END + 12 + 1 + 11) OVER w AS upto
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
    FROM sized GROUP BY conv_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    given = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.training_examples(given.unionByName(spark.sql(ADDED_CONVERSATION))))


@query(
    "op9_mixture_raking",
    f"""
    WITH docs AS ({mixing.cells_sql("documents")}),
    {mixing.raked_sql("docs")},
    aimed AS (SELECT *, CASE WHEN _tokens > 0 THEN _ratio * {mixing.RATE} ELSE 1 END AS aim FROM docs JOIN ratio USING (_source, _lang, _topic))
    SELECT doc_id, _source AS source, _lang AS lang, _topic AS topic, _tokens AS n_tokens, round(least(1, aim), 6) AS probability,
           round(greatest(1, aim), 6) AS weight, _u < least(1, aim) AS kept FROM aimed
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    sample = mixing.mixture_sample(load(spark, folder, "documents"))
    return sample.withColumns({c: F.round(c, 6) for c in ("probability", "weight")})


@query("op5_sentencepiece_codec")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(load(spark, folder, "documents"))


@query("op2_language_crf")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = language_crf.detect_languages(load(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_words", F.size("stretches").cast("long").alias("n_stretches"))


@query(
    "op10_embedding_caps",
    f"""
    WITH RECURSIVE unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    pairs AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {embedding_caps.COSINE}),
    reached(a, b) AS (SELECT vec_id, vec_id FROM unit UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b),
    least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM unit JOIN least ON a = vec_id
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_caps.embedding_classes(load(spark, folder, "embeddings"))


@query("op8_lm_trie")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return lm_trie.score_documents(load(spark, folder, "documents"))


@query("op7_pii_weak")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_weak.personal_data(load(spark, folder, "documents"))
    kinds = F.transform("base", lambda span: span["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii_weak.BASE]
    return found.select("doc_id", *counts, F.sha2(F.col("base_text").cast("binary"), 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


@query("op4_kneser_ney_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    trusted = load(spark, folder, "labels").where("quality = 1 AND toxic = 0")
    return kneser_ney.quality_verdicts(load(spark, folder, "documents"), trusted)


@query("op1_jaccard_pivots")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_pivots.near_duplicate_classes(load(spark, folder, "documents"))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing.packed_pieces(load(spark, folder, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its id, ends in a passage that repeats: the rows of the contract."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    placed = split.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    sized = placed.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1)
    planted = F.expr("array_join(transform(_words, (w, i) -> CASE WHEN i < _a THEN w ELSE get(_words, CAST(_a + (i - _a) % _p AS INT)) END), ' ')")
    return sized.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.text_runs(with_planted_periods(load(spark, folder, "documents")))
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumns({"_top": F.array_max(ranked), "_lines": F.array_join(lines, "")})
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_top.length") / -F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit (DuckDB has no function for it)."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}), 4294967295)"


def rebuilt(turns: DataFrame) -> DataFrame:
    """The conversations of the contract: the first h turns come from the conversation at the last multiple of five."""
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_head"))
    based = turns.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "_base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return based.select("conv_id", F.concat(first, rest).alias("turns"))


@query(
    "op12_prefix_trie",
    f"""
    WITH given AS (
        SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS b
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({{'m': m, 'b': b}} ORDER BY turn NULLS FIRST, m) AS turns, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM given GROUP BY conv_id),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
        FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
    begun AS (
        SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda t: t.m), '') AS path, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS b, d = len(turns) AS ends
        FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
    nodes AS (
        SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM begun GROUP BY path, d),
    kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
    leafy AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (path)),
    below AS (
        SELECT left(path, 64 * a) AS path, sum((n - 1) * b)::BIGINT AS saved, count(*) FILTER (k = 0) AS leaves
        FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM leafy) GROUP BY 1)
    SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, below.leaves AS n_leaves,
           below.saved AS saved_tokens, x.ends_sha256
    FROM leafy x JOIN below USING (path) LEFT JOIN nodes up ON x.d > 0 AND up.path = left(x.path, 64 * (x.d - 1))
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_nodes(rebuilt(prefix_trie.conversation_turns(load(spark, folder, "conversations"))))

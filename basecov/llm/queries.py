"""Registered queries of the operators in this package: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecov.llm import bpe, collocations, decontaminate, html_text, jaccard, packing, quality, ranked_search, substrings, token_files, tool_calls, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, added_tokens=True)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op4_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, *html_text.learn(pages)).select("page_id", "url", "text", "n_chars")


@query
def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_headers(warc.resolve_revisits(archives, least_bytes=0))
    page, refers = (F.nullif(c, F.lit(warc.LOWEST)).alias(c) for c in ("page_id", "refers_to"))
    return records.select(page, "payload_bytes", "payload_digest", "record_type", refers)


@query
def op7_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents").select("doc_id", "text"), length=3, percent=90)


@query
def op8_doubling_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.removable(table(spark, sf_dir, "documents").select("doc_id", "text"), length=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: What the turns of a conversation are called with: a system turn instructs, a user turn asks.
TOOLS: tool_calls.Schema = {
    "instruct": {"prompt": {"type": "string", "required": True, "minLength": 1}, "turn": {"type": "integer", "required": True, "maximum": 0}},
    "reply": {"prompt": {"type": "string", "required": True, "minLength": 1, "maxLength": 600}, "turn": {"type": "integer", "required": True, "minimum": 0}},
}


@query
def op9_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every system and user turn is a call, every other turn (also one without a role) the result of the turn before; a call depends on the call two turns before."""
    turns = table(spark, sf_dir, "conversations")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    name = F.when(F.col("role") == "system", "instruct").otherwise("reply")
    calls = turns.where("role IN ('system', 'user')").select("conv_id", F.concat(F.lit("c"), "turn").alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.concat(F.lit("c"), F.col("turn") - 2).alias("depends_on"))
    results = turns.where("coalesce(role NOT IN ('system', 'user'), true)").select("conv_id", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    linked = tool_calls.link(calls, results, TOOLS)
    return linked.select("conv_id", "call_id", "turn", "level", "status", F.array_join("errors", ",").alias("errors"), "json")


ORACLES["op9_tool_call_links"] = """
WITH RECURSIVE calls AS (
    SELECT conv_id, 'c' || turn AS call_id, turn, CASE WHEN role = 'system' THEN 'instruct' ELSE 'reply' END AS name, text, 'c' || (turn - 2) AS depends_on
    FROM conversations WHERE role IN ('system', 'user')
), results AS (
    SELECT conv_id, 'c' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE coalesce(role NOT IN ('system', 'user'), true)
), tree AS (
    SELECT c.conv_id, c.call_id, c.turn, CAST(0 AS BIGINT) AS level FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.depends_on WHERE p.call_id IS NULL
    UNION ALL
    SELECT c.conv_id, c.call_id, c.turn, t.level + 1 FROM calls c JOIN tree t ON t.conv_id = c.conv_id AND t.call_id = c.depends_on
), checked AS (
    SELECT c.*, t.level, r.content, r.call_id IS NOT NULL AS answered,
        list_filter([
            CASE WHEN name = 'instruct' AND c.turn > 0 THEN 'maximum: turn' END,
            CASE WHEN name = 'reply' AND length(text) > 600 THEN 'maxLength: prompt' END,
            CASE WHEN length(text) < 1 THEN 'minLength: prompt' END,
            CASE WHEN name = 'reply' AND c.turn < 0 THEN 'minimum: turn' END,
            CASE WHEN text IS NULL THEN 'type: prompt' END
        ], lambda e: e IS NOT NULL) AS errors
    FROM calls c JOIN tree t ON t.conv_id = c.conv_id AND t.call_id = c.call_id
    LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
), rows AS (
    SELECT conv_id, call_id, turn, level, CASE WHEN answered THEN 'linked' ELSE 'no result' END AS status, errors,
        json_object('prompt', text, 'turn', turn) AS arguments, depends_on, name, content FROM checked
    UNION ALL
    SELECT r.conv_id, r.call_id, r.turn, NULL, 'no call', CAST([] AS VARCHAR[]), NULL, NULL, NULL, r.content
    FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
)
SELECT conv_id, call_id, turn, level, status, array_to_string(errors, ',') AS errors,
    CAST(json_object('arguments', arguments, 'call_id', call_id, 'conv_id', conv_id, 'depends_on', depends_on, 'errors', errors, 'level', level, 'name', name, 'result', content, 'status', status, 'turn', turn) AS VARCHAR) AS json
FROM rows
"""


@query
def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.expr("array_sort(array_distinct(transform(matches, m -> string(m.item_id))))")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


@query
def op11_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_limited_accumulators"] = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (
    SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM lengths
), tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term
), asked AS (
    SELECT item_id, term, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ) GROUP BY item_id, term
), scores AS (
    SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query
def op12_dynamic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


ORACLES["op12_dynamic_collocations"] = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, w FROM (
        SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents)
), words AS (
    SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM pieces
), runs AS (
    SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM words
), grams AS (
    SELECT lang, 1 AS k, w1 AS phrase, w1, NULL AS w2, NULL AS w3 FROM runs
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3 FROM runs WHERE w3 IS NOT NULL
), counts AS (
    SELECT lang, k, phrase, lang || chr(1) || phrase AS id, count(*) AS a, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3 FROM grams GROUP BY lang, k, phrase
), totals AS (
    SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), cuts AS (
    SELECT lang, 2 AS k, phrase, a, w1 AS x, w2 AS y, 1 AS cut FROM counts WHERE k = 2 AND a >= 10
    UNION ALL SELECT lang, 3, phrase, a, w1, w2 || ' ' || w3, 1 FROM counts WHERE k = 3 AND a >= 10
    UNION ALL SELECT lang, 3, phrase, a, w1 || ' ' || w2, w3, 2 FROM counts WHERE k = 3 AND a >= 10
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, c.cut, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
    FROM cuts c JOIN counts x ON x.id = c.lang || chr(1) || c.x JOIN counts y ON y.id = c.lang || chr(1) || c.y
), weakest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored) WHERE place = 1
), inside AS (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM counts WHERE k = 3 AND a >= 10
    UNION ALL SELECT lang, w2 || ' ' || w3, a FROM counts WHERE k = 3 AND a >= 10
), kept AS (
    SELECT p.* FROM weakest p LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY lang, phrase) i ON p.k = 2 AND i.lang = p.lang AND i.phrase = p.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 50 * p.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, added_tokens=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import decontaminate, html, imatch, langid, licenses, neardup, packing, pii, prefixtrie, quality, substrings, toxicity, vectorcodes
from driftwarden.llm.common import held_out, table

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    lines = F.size(F.filter(F.split("ht_text", "\n"), lambda x: x != ""))
    return found.select("page_id", "url", F.col("ht_title").alias("title"), F.col("ht_text").alias("text"), F.char_length("ht_text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out())
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("tx_score").alias("score"),
        (F.col("tx_score") >= 0.5).cast("int").alias("predicted"),
        F.size("tx_matches").cast("long").alias("n_matches"),
        F.size(F.filter("tx_matches", lambda m: m["edits"] > 0)).cast("long").alias("n_misspelled"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer(), with_ids=False)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~held_out())
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"), F.col("li_entropy").alias("bits_per_symbol"), F.col("li_rejected").alias("rejected"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "dc_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.k, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT k, i, n FROM hits)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), F.col("nd_shingles").alias("n_shingles"), F.col("nd_component").alias("component_id"), F.col("nd_kept").alias("kept"))


OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
c AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    base = F.filter("pii_spans", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. ``shared_spans`` are held by other documents too, ``repeated_spans`` also hold what repeats within one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    short = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), substrings.row_key("text").alias("row"))
    found = substrings.with_marks(short, substrings.marked(docs), "doc_id", "row")
    spans = lambda c: F.coalesce(F.array_join(F.transform(f"_marks.{c}", lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit("")).alias(f"{c[3:]}_spans")
    chars = lambda c: F.coalesce(F.aggregate(f"_marks.{c}", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long")).alias(f"{c[3:]}_chars")
    kinds = ("sd_repeated", "sd_shared", "sd_removed")
    return found.select(
        "doc_id",
        "n_chars",
        F.coalesce("_marks.sd_chunks", F.lit(0).cast("long")).alias("n_repeated_chunks"),
        *(chars(c) for c in kinds),
        *(spans(c) for c in kinds),
        F.coalesce("_marks.sd_first", F.array().cast("array<long>")).alias("first_doc_ids"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    best = F.coalesce(F.array_max("ls_notices.likeness"), F.lit(0.0))
    return found.select(
        "doc_id",
        F.col("ls_words").alias("n_words"),
        F.size("ls_base").cast("long").alias("n_base"),
        F.array_min("ls_base.word").alias("first_word"),
        F.array_max("ls_base.word").alias("last_word"),
        labels("ls_base.label").alias("base_labels"),
        labels("ls_base.label", "ls_notices.label").alias("labels"),
        F.when(F.size("ls_base") > 0, 1.0).otherwise(best).alias("score"),
        F.array_join(F.transform("ls_notices", lambda x: F.concat_ws(":", x["label"], x["first"], x["last"], x["edits"])), ",").alias("notices"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.numbered(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(prefixtrie.with_heads(turns))


#: A turn's digest settles the order of a conversation's rows with the same turn, as in the operator.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)[1:32]) - 1 AS i, {'r': role, 't': text} AS x
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(x ORDER BY i) AS x FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, x, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v // 2, (v % 2) * 3988292384))) AS s FROM own),
h AS (SELECT conv_id, x, xor(s, 4294967295::BIGINT) % 6 AS h FROM crc),
c AS (SELECT h.conv_id, list_concat(coalesce(list_slice(own.x, 1, h.h), []), list_slice(h.x, h.h + 1, len(h.x))) AS x FROM h LEFT JOIN own ON own.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, unnest(range(0, len(x) + 1)) AS d, x FROM c),
m AS (SELECT d, list_slice(x, 1, d) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(x) = d), '')) AS ends_sha256 FROM p GROUP BY d, path),
k AS (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
n AS (SELECT m.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN m.d > 0 THEN (n_convs - 1) * length(m.path[m.d].t) ELSE 0 END AS saved FROM m LEFT JOIN k ON k.d = m.d AND k.path = m.path),
u AS (SELECT list_slice(path, 1, a) AS path, saved, (n_children = 0)::BIGINT AS leaf FROM (SELECT path, saved, n_children, unnest(range(0, d + 1)) AS a FROM n)),
s AS (SELECT path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM u GROUP BY path)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN m q ON q.d = n.d - 1 AND q.path = list_slice(n.path, 1, n.d - 1)
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~kept_out)
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", kept_out.alias("held_out"), F.col("ql_score").alias("score"), (F.col("ql_score") >= 0.5).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectorcodes.fit(vectors)
    coded = vectorcodes.with_group_errors(vectorcodes.encode(vectors, books, keep=["vec_id", "label"]), "label")
    return coded.select("vec_id", F.col("vc_code").alias("code"), F.col("vc_error").alias("error"), F.col("vc_group_error").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {fine})",
        f"p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS x FROM k, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p JOIN k USING (vec_id) WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, part, min(({distance}) * {entries} + entry) AS best FROM p JOIN c{n} c USING (part) GROUP BY vec_id, part)")
        if n < rounds:
            steps += [
                f"s{n} AS (SELECT part, best % {entries} AS entry, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{n} JOIN p USING (vec_id, part)) GROUP BY ALL)",
                f"m{n} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{n} GROUP BY ALL)",
                f"c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (part, entry))",
            ]
    steps += [
        f"e AS (SELECT vec_id, string_agg(printf('%02x', (best % {entries})::BIGINT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)",
        f"b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), b"


SCALE = vectorcodes.SCALE
OP13_SQL = _op13_sql()


def queries() -> dict:
    return {"op1_html": op1_html, "op2_toxicity": op2_toxicity, "op3_fingerprints": op3_fingerprints, "op4_pack": op4_pack, "op5_language": op5_language, "op6_decontaminate": op6_decontaminate, "op7_near_duplicates": op7_near_duplicates, "op8_pii": op8_pii, "op9_substrings": op9_substrings, "op10_licenses": op10_licenses, "op11_prefix_trie": op11_prefix_trie, "op12_quality": op12_quality, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}

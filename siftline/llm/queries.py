"""The registered queries of this subpackage, and their SQL where SQL can express them."""


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bytepairs, containment, langid, licenses, minhash, negatives, pages, pieces, quality, rans, revisit, tries, weighted
from siftline.llm.common import learnable, shared_dir, ship, table, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    rans.write_token_file(table(spark, sf_dir, "documents"), path, rans.word_bpe(tokenizer_path("word_bpe_49k.json")), end_id=1, vocabulary=49408)
    back = rans.read_token_file(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compared(table(spark, sf_dir, "documents"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl log made of pages: a page was answered in full up to four times (twice at one time, the last time perhaps
    after its revisit), and visited again with a 304; every tenth page also under a name that is no URL."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    header = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    day = lambda c: F.concat(F.lit("day "), c.cast("string"))
    page, k = F.col("page_id"), F.col("k")
    tag = F.concat(F.substring("digest", 1, 16), k.cast("string"))
    answers = p.withColumn("k", F.explode(F.sequence(F.lit(0), (page % 4).cast("int"))))
    # the answers 1 and 2 come at one time
    at = page * 10 + F.least(k, F.lit(1)) * 500 + F.when(k == 3, 3000).otherwise(0)
    full = answers.select(
        (page * 10 + k).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), F.concat(F.lit('"'), tag, F.lit('"')).alias("etag"), day(F.floor(page / 100) + k).alias("last_modified"),
        header("content-type", "text/html", "date", day(page * 10 + k), "etag", tag, "server", "a").alias("headers"),
    )
    named = F.when(page % 10 == 9, F.concat(F.lit("dns:"), F.col("digest"))).otherwise(F.concat("url", F.when(F.col("url").contains("?") | F.col("url").contains("#"), "").otherwise("?utm_campaign=x#again")))
    # validators of one of the answers
    seen = F.concat(F.substring("digest", 1, 16), (page % 3).cast("string"))
    again = p.select(
        (page * 10 + 9).alias("record_id"), named.alias("url"), (page * 10 + page % 7 * 700 - 5).alias("at"), F.lit("revisit").alias("kind"),
        F.when(page % 5 < 3, F.concat(F.lit('W/"'), seen, F.lit('"'))).when(page % 5 == 3, F.lit('"changed"')).alias("etag"), F.when(page % 4 != 0, day(F.floor(page / 100) + page % 2)).alias("last_modified"),
        header("content-length", "0", "date", day(page * 10 + 1), "expires", "never", "server", "b").alias("headers"),
    )
    return full.unionByName(again)


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisit.resolve(capture_records(spark, sf_dir))
    return out.select("record_id", "url_key", "response_id", "verdict", revisit.header_lines(F.col("headers")).alias("header_lines"))


OP5_SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest FROM pages),
answers AS (SELECT *, unnest(range(0, page_id % 4 + 1)) AS k FROM p),
recs AS (
  SELECT page_id * 10 + k AS record_id, url, page_id * 10 + least(k, 1) * 500 + CASE WHEN k = 3 THEN 3000 ELSE 0 END AS at, 'response' AS kind,
         '"' || substr(digest, 1, 16) || CAST(k AS VARCHAR) || '"' AS etag, 'day ' || CAST(page_id // 100 + k AS VARCHAR) AS last_modified,
         substr(digest, 1, 16) || CAST(k AS VARCHAR) AS tag, page_id, k FROM answers
  UNION ALL
  SELECT page_id * 10 + 9, CASE WHEN page_id % 10 = 9 THEN 'dns:' || digest ELSE url || CASE WHEN contains(url, '?') OR contains(url, '#') THEN '' ELSE '?utm_campaign=x#again' END END,
         page_id * 10 + page_id % 7 * 700 - 5, 'revisit',
         CASE WHEN page_id % 5 < 3 THEN 'W/"' || substr(digest, 1, 16) || CAST(page_id % 3 AS VARCHAR) || '"' WHEN page_id % 5 = 3 THEN '"changed"' END,
         CASE WHEN page_id % 4 <> 0 THEN 'day ' || CAST(page_id // 100 + page_id % 2 AS VARCHAR) END, NULL, page_id, NULL FROM p),
keyed AS (
  SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_'))), '&') AS query
  FROM recs),
k AS (SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]') THEN base || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE url END AS url_key FROM keyed),
found AS (
  SELECT v.*, r.record_id AS response_id, r.etag AS r_etag, r.last_modified AS r_lm, r.tag AS r_tag,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.at DESC, r.record_id DESC) AS rn
  FROM (SELECT * FROM k WHERE kind = 'revisit') v LEFT JOIN (SELECT * FROM k WHERE kind = 'response') r ON v.url_key = r.url_key AND r.at <= v.at),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', ''), last_modified = r_lm) IS NULL THEN 'unverified'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', ''), last_modified = r_lm) THEN 'match' ELSE 'mismatch' END AS verdict
  FROM found WHERE rn = 1)
SELECT record_id, url_key, response_id, verdict,
  CASE WHEN verdict IN ('match', 'unverified')
    THEN 'content-type: text/html' || chr(10) || 'date: day ' || CAST(page_id * 10 + 1 AS VARCHAR) || chr(10) || 'etag: ' || r_tag || chr(10) || 'expires: never' || chr(10) || 'server: a'
    ELSE 'content-length: 0' || chr(10) || 'date: day ' || CAST(page_id * 10 + 1 AS VARCHAR) || chr(10) || 'expires: never' || chr(10) || 'server: b' END AS header_lines
FROM judged
"""


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents what its encoded and decoded chunks add up to; exact: all chunks decode to the text that they cover."""
    path = tokenizer_path("piece_bpe_32k.model")
    out = pieces.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.groupBy("doc_id", "row_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.size("ids")).alias("n_tokens"), F.sum(F.char_length("decoded")).alias("n_chars"), F.bool_and(F.col("decoded") == F.translate("text", pieces.SPACE, " ")).alias("exact"),
        # a row's chunks have different numbers, so no two of them cancel each other
        F.expr("bit_xor(xxhash64(chunk, ids))").alias("ids_hash"),
    ).drop("row_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(learnable(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = quality.labelled(docs.where(learnable(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    out = quality.classify(docs, quality.fit(taught), threshold=0.3)
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.col("label").cast("long")
    rows = vectors.select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor"),
    )
    return negatives.mine(rows, n_positives=5, n_negatives=3, low=50, high=95)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.r AS anchor_row, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id NULLS LAST) AS k FROM p WHERE same) WHERE k <= 5),
neg AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, p.vec_id AS negative_id, pos.score AS positive_score, p.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor_row, pos.k ORDER BY p.score DESC, p.vec_id NULLS LAST) AS rank
  FROM pos JOIN p ON pos.anchor_row = p.anchor_row AND NOT p.same AND 50 * pos.score <= 100 * p.score AND 100 * p.score <= 95 * pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytepairs.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def rebuilt_conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first crc32(c) % 6 turns of conversation c - c % 100 in place of as many of its own: turns and ids."""
    turns = written(tries.numbered(table(spark, sf_dir, "conversations")), "rebuilt-from")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h)
    first = turns.where("j <= 5")
    given = convs.join(first.withColumnRenamed("conv_id", "base"), "base").where("j <= h").select("conv_id", "j", "key", "chars")
    moved = convs.select("conv_id", "h", "base").join(convs.select(F.col("conv_id").alias("base"), "n"), "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("by"))
    own = turns.join(moved, "conv_id").where("j > h").select("conv_id", (F.col("j") + F.col("by")).alias("j"), "key", "chars")
    return written(given.unionByName(own), "rebuilt"), convs.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(*rebuilt_conversations(spark, sf_dir))


OP13_SQL = """
WITH ids AS (
  SELECT DISTINCT conv_id AS c, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)) AS digits FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), digits),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x // 2, (x % 2) * 3988292384))), 4294967295) % 6 AS h
  FROM ids),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(t ORDER BY i) AS w FROM turns GROUP BY c),
whole AS (SELECT convs.c, list_concat(coalesce(b.w[1 : h], []), o.w[h + 1 :]) AS w FROM convs JOIN lists o ON o.c = convs.c LEFT JOIN lists b ON b.c = convs.base),
prefixes AS (SELECT c, d, w[1 : d] AS p, d = len(w) AS ends FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM whole)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].text) ELSE 0 END AS saved
  FROM prefixes GROUP BY p, d),
kids AS (SELECT u.p, count(v.p) AS n FROM nodes u LEFT JOIN nodes v ON v.d = u.d + 1 AND v.p[1 : u.d] = u.p GROUP BY u.p)
SELECT u.conv_id, u.d AS depth, any_value(up.conv_id) AS parent_conv_id, any_value(u.n_convs) AS n_convs, any_value(k.n) AS n_children,
       count(*) FILTER (WHERE below.n = 0) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens, any_value(u.ends_sha256) AS ends_sha256
FROM nodes u JOIN kids k ON k.p = u.p LEFT JOIN nodes up ON up.d = u.d - 1 AND up.p = u.p[1 : u.d - 1]
JOIN nodes v ON v.d >= u.d AND v.p[1 : u.d] = u.p JOIN kids below ON below.p = v.p
GROUP BY u.conv_id, u.d
"""

OP2_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
templates(t, label, base, words) AS (VALUES TEMPLATES),
phrases(t, n, place, p) AS (VALUES PHRASES),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT rid, unnest(w) AS word FROM w) WHERE word IN (SELECT unnest(p) FROM phrases) GROUP BY word),
ranked AS (SELECT t, phrases.n AS phrase, word, row_number() OVER (PARTITION BY t, phrases.n ORDER BY df.n, word) AS rank FROM phrases, (SELECT DISTINCT t AS t2, n AS n2, unnest(p) AS word FROM phrases) x JOIN df USING (word) WHERE t = t2 AND phrases.n = n2),
indexed AS (SELECT DISTINCT t, word FROM ranked WHERE rank <= 2),
anchors AS (SELECT DISTINCT word FROM ranked JOIN templates USING (t) WHERE base AND rank = 1),
places AS (SELECT t, base, words[i + 1] AS word, i AS place FROM (SELECT t, base, words, unnest(range(0, len(words))) AS i FROM templates)),
idx AS (SELECT places.* FROM places JOIN indexed USING (t, word)),
found AS (SELECT rid, word, i - 1 AS pos FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) WHERE word IN (SELECT word FROM indexed)),
tops AS (SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY df.n, word) AS rank FROM (SELECT DISTINCT rid, word FROM found) JOIN df USING (word)),
chosen AS (SELECT found.* FROM found JOIN tops USING (rid, word) WHERE rank <= LOOKED_UP OR word IN (SELECT word FROM anchors)),
offsets AS (
  SELECT DISTINCT c.rid, i.t, c.pos - i.place AS o FROM chosen c JOIN idx i USING (word) JOIN w ON w.rid = c.rid
  WHERE i.base OR EXISTS (SELECT 1 FROM idx j WHERE j.t = i.t AND j.word <> i.word AND c.pos - i.place + j.place >= 0 AND w.w[c.pos - i.place + j.place + 1] = j.word)),
stands AS (SELECT DISTINCT offsets.rid, p.t, p.n, o + p.place AS pos, p.p FROM offsets JOIN phrases p USING (t) JOIN w ON w.rid = offsets.rid WHERE o + p.place >= 0 AND w.w[o + p.place + 1 : o + p.place + len(p.p)] = p.p),
shares AS (SELECT offsets.rid, max(len(list_filter(range(0, len(t.words)), lambda i: o + i >= 0 AND coalesce(w.w[o + i + 1] = t.words[i + 1], false))) / len(t.words)) AS score FROM offsets JOIN templates t USING (t) JOIN w ON w.rid = offsets.rid GROUP BY offsets.rid),
matched AS (SELECT rid, t, count(DISTINCT n) AS n FROM stands GROUP BY rid, t),
lab AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels
  FROM matched JOIN templates USING (t) JOIN (SELECT t, count(*) AS all_n FROM phrases GROUP BY t) USING (t) WHERE n = all_n GROUP BY rid),
b AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM stands JOIN templates USING (t) WHERE base GROUP BY rid)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN lab USING (rid) LEFT JOIN b USING (rid) LEFT JOIN shares USING (rid)
"""

OP10_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS h FROM words WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_shared
FROM s d JOIN s i ON d.h = i.h AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""


def _op2_sql() -> str:
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = [f"({t}, '{x.label}', {str(x.base).lower()}, {listed(x.words)})" for t, x in enumerate(licenses.TEMPLATES)]
    phrases = [f"({t}, {k}, {x.place(p)}, {listed(p.split())})" for t, x in enumerate(licenses.TEMPLATES) for k, p in enumerate(x.phrases)]
    return OP2_SQL.replace("TEMPLATES", ", ".join(templates)).replace("PHRASES", ", ".join(phrases)).replace("LOOKED_UP", str(licenses.LOOKED_UP))


def queries() -> dict:
    named = [op1_token_file, op2_license_scan, op3_weighted_fingerprints, op4_page_text, op5_revisits, op6_pieces, op7_language, op8_near_duplicates, op9_quality, op10_decontamination, op11_hard_negatives, op12_byte_pairs, op13_prefix_trie]

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2_sql(), "op5_revisits": OP5_SQL, "op10_decontamination": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL}

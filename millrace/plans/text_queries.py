"""Text hygiene over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import chunking
from millrace.session import table


def f01_scrub(spark, sf_dir):
    """Masked text by its hash, and how many masks it has."""
    out = table(spark, sf_dir, "documents").select("doc_id", text.mask_numbers_and_addresses(F.col("text")).alias("t"))
    return out.select("doc_id", F.md5("t").alias("masked"), F.regexp_count("t", F.lit(r"\[(?:email|number|handle)\]")).alias("n"))


def f01_scrub_names(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", text.scrub(F.col("text"), ("orin", "orinda")).alias("t"))
    return out.select("doc_id", F.regexp_count("t", F.lit(text.TOKEN)).alias("n"))


def f02_leaks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.array_join(text.leak_reasons(F.col("text")), ",").alias("reasons")).agg(F.count("*").alias("n"))


def f03_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise_question(F.col("text"))).alias("norm"))


def f06_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("clipped"))


def f08_secrets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.redact_keys(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("redacted"), F.contains("t", F.lit("[REDACTED_KEY]")).alias("changed"))


def f22_segments(spark, sf_dir):
    """Plain ASCII of at most 300 characters, in segments of 153."""
    ascii_ = F.substring(F.regexp_replace("text", "[^ -~]+", " "), 1, 300)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ascii_.alias("t"))
    return c.select("conv_id", "turn", F.when(F.length("t") <= 160, 1).otherwise(F.ceil(F.length("t") / 153)).cast("bigint").alias("segments"))


def f26_contamination(spark, sf_dir):
    """Benchmark items and documents by the 8-grams that they share."""
    grams = lambda df, i: df.select(i, F.explode(F.array_distinct(text.ngrams(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), 8))).alias("g"))
    items, docs = grams(table(spark, sf_dir, "benchmark"), "item_id"), grams(table(spark, sf_dir, "documents"), "doc_id")
    return docs.join(items, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))


def f25_echo(spark, sf_dir):
    """Turns of a conversation that repeat a run of four words of the turn before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.ngrams(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), 4)).alias("g"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("g").alias("g0"))
    joined = c.join(before, ["conv_id", "turn"])
    return joined.select("conv_id", "turn", F.arrays_overlap("g", "g0").alias("echo"), F.size(F.array_except("g", "g0")).alias("fresh"))


def f29_chunks(spark, sf_dir):
    d = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", "chunk", F.size(F.split(F.trim("chunk_text"), r"\s+")).alias("words"), F.md5("chunk_text").alias("text_md5"))


def f34_clean_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    url = F.regexp_replace("url", "ref=", "utm_ref=")
    return p.select("page_id", text.drop_tracking(url).alias("url"), text.host_label(F.col("url")).alias("host"))


def f39_syllables(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    return words.groupBy("item_id").agg(F.sum(text.syllables(F.col("w"))).alias("syllables"))


def f60_extract_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n``` done")).alias("reply"))
    return e.select("event_id", F.get_json_object(text.extract_json(F.col("reply")), "$.k").alias("k"))


def f67_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(F.sha2(F.concat_ws("|", "source", "lang", "text"), 256), 1, 16).alias("cache_key"))


def f68_client_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.substring(text.hmac_sha256("millrace", F.col("user_id").cast("string")), 1, 16).alias("client"))


def s33_csv_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("cell", F.concat(F.when(F.col("doc_id") % 9 == 0, "=").otherwise(""), F.col("text")))
    return d.groupBy("lang").agg(F.count_if(text.csv_cell(F.col("cell")) != F.col("cell")).alias("escaped"), F.count("*").alias("n"))


def a36_boilerplate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("deck", F.concat_ws("-", "source", "lang"))
    return chunking.boilerplate_lines(d, "deck", "doc_id", share=0.1)


def a37_vocabulary(spark, sf_dir):
    return chunking.lower_vocabulary(table(spark, sf_dir, "documents").filter("lang = 'en'"), least=50)


def a46_leak_hits(spark, sf_dir):
    """Words found in string columns, by place: unpivot, then a semi-join with the list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    cells = d.selectExpr("doc_id", "stack(3, 'text', text, 'lang', lang, 'source', source) AS (place, cell)")
    words = cells.select("place", F.explode(F.regexp_extract_all(F.lower("cell"), F.lit("([a-z0-9]+)"), 1)).alias("w"))
    listed = spark.createDataFrame([("idiot",), ("license",), ("en",), ("src3",)], "w string")
    return words.join(F.broadcast(listed), "w", "left_semi").groupBy("place", "w").agg(F.count("*").alias("n"))


def p16_content_flags(spark, sf_dir):
    words = text.any_case("licensed? under|all rights reserved")
    rules = (("license", f"{text.BEGIN}(?:{words}){text.END}"), ("secret", text.API_KEY), ("table", r" \| "))
    flags = F.array_compact(F.array(*(F.when(F.regexp_like("text", F.lit(p)), n) for n, p in rules)))
    return table(spark, sf_dir, "documents").groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count("*").alias("n"))


def p17_stuck_transcript(spark, sf_dir):
    """Texts whose commonest line makes up half of them, or with at most three different lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    per = lines.groupBy("doc_id", "line").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.count("*").alias("kinds"))
    return per.select("doc_id", ((F.col("n") >= 4) & ((F.col("top") >= 0.5 * F.col("n")) | (F.col("kinds") <= 3))).alias("stuck"))


QUERIES = {
    f.__name__: f
    for f in (
        f01_scrub, f01_scrub_names, f02_leaks, f03_norm, f06_clip, f08_secrets, f22_segments, f26_contamination, f25_echo, f29_chunks, f34_clean_url, f39_syllables, f60_extract_json, f67_hashes, f68_client_hash, s33_csv_guard, a36_boilerplate,
        a37_vocabulary, a46_leak_hits, p16_content_flags, p17_stuck_transcript,
    )
}


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


# The patterns of the SQL stand by themselves, in the syntax of an engine without look-around: a guard before
# or behind a match is matched too and put back, twice, since neighbours may share it.
def _masked(column: str) -> str:
    mail = f"regexp_replace({column}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z][A-Za-z]+', '[email]', 'g')"
    handle = f"regexp_replace({mail}, '(^|[^A-Za-z0-9_@])@[A-Za-z0-9_.][A-Za-z0-9_.]+', '\\1[handle]', 'g')"
    phone = handle
    for _ in range(2):
        phone = f"regexp_replace({phone}, '(^|[^0-9A-Za-z_.])([+][0-9]{{1,3}}[\\s.-]?)?[(]?[0-9]{{3}}[)]?[\\s.-]?[0-9]{{3}}[\\s.-][0-9]{{4}}($|[^0-9A-Za-z_.])', '\\1[number]\\3', 'g')"
    return f"regexp_replace({phone}, '\\b[0-9]{{7}}[0-9]*\\b', '[number]', 'g')"


def _named(column: str, keep: str | None = None) -> str:
    name = "[A-Z][a-zA-Z''-]+(?:\\s+[A-Z][a-zA-Z''-]+)?"
    leads = (
        ("\\b((?i:my name is|my name''s|i am called|i''m called|call me)\\s+)", "[name]"), ("\\b((?:Prof|Professor|Dr|Mr|Mrs|Ms|Mx)[.]?\\s+)", "[person]"),
        ("\\b((?i:classmate|teammate|partner|friend|roommate|ta|student|groupmate)s?\\s+)", "[student]"),
    )
    for lead, token in leads:
        if keep:  # a mark between a lead and a kept name, taken out again
            column = f"regexp_replace({column}, '{lead}((?i:{keep})(?:\\s|$|[^A-Za-z''-]))', '\\1' || chr(1) || '\\2', 'g')"
        column = f"regexp_replace({column}, '{lead}{name}', '\\1{token}', 'g')"
        column = f"replace({column}, chr(1), '')" if keep else column
    return column


_KEY = "\\b(?:sk-[A-Za-z0-9_-]{8,}|AKIA[A-Z0-9]{8,}|gh[po]_[A-Za-z0-9]{8,}|xi-[A-Za-z0-9]{8,})"
_TOKENS = "\\[(?:email|number|handle|name|person|student)\\]"
#: The padded keys of a keyed hash, as blobs.
_PADS = [bytes(b ^ pad for b in b"millrace".ljust(64, b"\0")).hex() for pad in (0x5C, 0x36)]
_GRAMS = "list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {m} + 1), lambda i: array_to_string(w[i:i + {m}], ' ')) ELSE []::VARCHAR[] END)"
_WC = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
#: Paragraphs, long ones taken apart at sentences and packed again, then packed into chunks: both by recursion.
_CHUNKS = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pi FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n+') AS ps FROM documents)),
par AS (SELECT doc_id, pi, p, {_WC.format("p")} AS n FROM (SELECT doc_id, pi, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM raw) WHERE p <> ''),
sen AS (SELECT doc_id, pi, unnest(ss) AS s, unnest(range(len(ss))) AS si FROM (SELECT doc_id, pi, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM par WHERE n > 400)),
part AS (SELECT doc_id, pi, si, 0 AS wi, s AS t FROM sen WHERE {_WC.format("s")} <= 400
  UNION ALL SELECT doc_id, pi, si, wi, array_to_string(ws[wi * 400 + 1:wi * 400 + 400], ' ') FROM (SELECT doc_id, pi, si, ws, unnest(range(ceil(len(ws) / 400.0)::BIGINT)) AS wi
    FROM (SELECT doc_id, pi, si, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS ws FROM sen) WHERE len(ws) > 400)),
num AS (SELECT doc_id, pi, row_number() OVER (PARTITION BY doc_id, pi ORDER BY si, wi) AS i, t, {_WC.format("t")} AS n FROM part),
pack AS (SELECT doc_id, pi, i, n AS size, 0 AS no FROM num WHERE i = 1
  UNION ALL SELECT x.doc_id, x.pi, x.i, CASE WHEN size + n > 400 THEN n ELSE size + n END, no + (size + n > 400)::INT FROM pack JOIN num x ON x.doc_id = pack.doc_id AND x.pi = pack.pi AND x.i = pack.i + 1),
unit AS (SELECT doc_id, pi, 0 AS no, p AS t FROM par WHERE n <= 400
  UNION ALL SELECT doc_id, pi, no, string_agg(t, ' ' ORDER BY i) FROM pack JOIN num USING (doc_id, pi, i) GROUP BY doc_id, pi, no),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, no) AS i, t, {_WC.format("t")} AS n, regexp_matches(t, '{_q(chunking.OPENING)}') AS opens FROM unit),
fold AS (SELECT doc_id, i, n AS size, 0 AS no FROM u WHERE i = 1
  UNION ALL SELECT u.doc_id, u.i, CASE WHEN size + n > 400 OR (opens AND size >= 150) THEN n ELSE size + n END, no + (size + n > 400 OR (opens AND size >= 150))::INT FROM fold JOIN u ON u.doc_id = fold.doc_id AND u.i = fold.i + 1),
c AS (SELECT doc_id, no, sum(n) AS size, max(no) OVER (PARTITION BY doc_id) AS top FROM fold JOIN u USING (doc_id, i) GROUP BY doc_id, no),
small AS (SELECT a.doc_id, a.no FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.no = b.no + 1 WHERE a.no = a.top AND a.size < 75 AND a.size + b.size <= 500),
placed AS (SELECT doc_id, i, t, fold.no - (small.no IS NOT NULL)::INT AS chunk FROM fold JOIN u USING (doc_id, i) LEFT JOIN small USING (doc_id, no))
SELECT doc_id, chunk, sum({_WC.format("t")})::INTEGER AS words, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5 FROM placed GROUP BY doc_id, chunk
"""
_G8, _G4 = _GRAMS.format(n=8, m=7), _GRAMS.format(n=4, m=3)
SQL = {
    "f01_scrub": f"WITH m AS (SELECT doc_id, {_masked('text')} AS t FROM documents) SELECT doc_id, md5(t) AS masked, len(regexp_extract_all(t, '\\[(?:email|number|handle)\\]'))::INTEGER AS n FROM m",
    "f01_scrub_names": f"WITH m AS (SELECT doc_id, {_masked('text')} AS t FROM documents), s AS (SELECT doc_id, {_named('t', 'orin|orinda')} AS t FROM m) SELECT doc_id, len(regexp_extract_all(t, '{_TOKENS}'))::INTEGER AS n FROM s",
    "f02_leaks": f"""WITH m AS (SELECT text, {_masked('text')} AS t FROM documents), s AS (SELECT text, {_named('t')} AS t, regexp_matches(text, '{_TOKENS}') AS token FROM m)
SELECT concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z][A-Za-z]+') THEN 'email' END, CASE WHEN regexp_matches(text, '(?i)https?://[^\\s]+') THEN 'url' END,
  CASE WHEN regexp_matches(text, '\\b[0-9]{{7}}[0-9]*\\b') THEN 'long number' END, CASE WHEN regexp_matches(text, '{_KEY}') THEN 'api key' END, CASE WHEN token THEN 'scrub token' END,
  CASE WHEN t <> text AND NOT token THEN 'personal detail' END) AS reasons, count(*) AS n FROM s GROUP BY 1""",
    "f03_norm": "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm FROM documents",
    "f06_clip": r"WITH c AS (SELECT doc_id, text, left(text, 80) AS c FROM documents), b AS (SELECT *, regexp_extract(c, '(?s)^(.*)\s\S*$', 1) AS b FROM c) SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN b <> '' THEN b ELSE c END AS clipped FROM b",
    "f08_secrets": f"WITH r AS (SELECT doc_id, regexp_replace(text, '{_KEY}', '[REDACTED_KEY]', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS redacted, contains(t, '[REDACTED_KEY]') AS changed FROM r",
    "f22_segments": "WITH t AS (SELECT conv_id, turn, left(regexp_replace(text, '[^ -~]+', ' ', 'g'), 300) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) <= 160 THEN 1 ELSE ceil(length(t) / 153.0) END::BIGINT AS segments FROM t",
    "f26_contamination": f"WITH a AS (SELECT item_id, unnest({_G8}) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)), b AS (SELECT doc_id, unnest({_G8}) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)) SELECT item_id, doc_id, count(*) AS n FROM a JOIN b USING (g) GROUP BY ALL",
    "f25_echo": f"WITH c AS (SELECT conv_id, turn, {_G4} AS g FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)) SELECT a.conv_id, a.turn, list_has_any(a.g, b.g) AS echo, len(list_filter(a.g, lambda x: NOT list_contains(b.g, x)))::INTEGER AS fresh FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1",
    "f29_chunks": _CHUNKS,
    "f34_clean_url": r"WITH u AS (SELECT page_id, url AS u0, regexp_replace(regexp_replace(url, 'ref=', 'utm_ref=', 'g'), '([?&])utm_[^&#]*&?', '\1', 'g') AS u FROM pages) SELECT page_id, regexp_replace(u, '[?&]+(#|$)', '\1', 'g') AS url, regexp_replace(lower(regexp_extract(u0, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM u",
    "f39_syllables": "WITH w AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark) SELECT item_id, sum(greatest(len(regexp_extract_all(w, '[aeiouy]+')) - regexp_matches(w, '[^aeiouyl]e$')::INT, 1))::BIGINT AS syllables FROM w GROUP BY 1",
    "f60_extract_json": "SELECT event_id, props::JSON->>'k' AS k FROM events",
    "f67_hashes": "SELECT doc_id, left(sha256(concat_ws('|', source, lang, text)), 16) AS cache_key FROM documents",
    "f68_client_hash": f"WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, left(sha256(from_hex('{_PADS[0]}') || from_hex(sha256(from_hex('{_PADS[1]}') || user_id::VARCHAR::BLOB))), 16) AS client FROM u",
    "s33_csv_guard": "WITH c AS (SELECT lang, CASE WHEN doc_id % 9 = 0 THEN '=' ELSE '' END || text AS c FROM documents) SELECT lang, count(*) FILTER (left(c, 1) IN ('=', '+', '-', '@', chr(9), chr(13))) AS escaped, count(*) AS n FROM c GROUP BY 1",
    "a36_boilerplate": "WITH d AS (SELECT source || '-' || lang AS deck, doc_id, lower(text) AS t FROM documents), l AS (SELECT DISTINCT deck, doc_id, trim(unnest(string_split(t, chr(10)))) AS line FROM d), s AS (SELECT deck, count(*) AS texts FROM d GROUP BY 1), c AS (SELECT deck, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL) SELECT deck, line, n FROM c JOIN s USING (deck) WHERE n >= greatest(3, floor(texts * 0.1))",
    "a37_vocabulary": r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang = 'en') WHERE w = lower(w) GROUP BY 1 HAVING n >= 50",
    "a46_leak_hits": "WITH c AS (SELECT 'text' AS place, text AS cell FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents), w AS (SELECT place, unnest(regexp_extract_all(lower(cell), '[a-z0-9]+')) AS w FROM c) SELECT place, w, count(*) AS n FROM w WHERE w IN ('idiot', 'license', 'en', 'src3') GROUP BY ALL",
    "p16_content_flags": rf"SELECT concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\blicensed? under\b|\ball rights reserved\b') THEN 'license' END, CASE WHEN regexp_matches(text, '{_KEY}') THEN 'secret' END, CASE WHEN regexp_matches(text, ' \| ') THEN 'table' END) AS flags, count(*) AS n FROM documents GROUP BY 1",
    "p17_stuck_transcript": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS c FROM l GROUP BY ALL), p AS (SELECT doc_id, max(c) AS top, sum(c) AS n, count(*) AS kinds FROM c GROUP BY 1) SELECT doc_id, n >= 4 AND (top >= 0.5 * n OR kinds <= 3) AS stuck FROM p",
}

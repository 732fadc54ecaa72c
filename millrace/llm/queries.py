"""The registered queries of the training-data operators, thin over the operators themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, chat, decontaminate, html_extract, langid, lexical, line_dedup, merkle, minhash, mixing, sketches, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_text(name: str) -> Column:
    """An id as text; a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, counts=True)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = pages.select("page_id", "url", html_extract.main_text(pages).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    held_out = lambda c: F.crc32(_id_text(c)) % 5 == 0
    model = toxicity.fit(docs, labels, ~held_out("id"))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.digest(chat.format_examples(turns.unionByName(planted)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    out = decontaminate.scan(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", *(f"report.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, root = _read(spark, sf_dir, "pages"), warc.fresh_root(spark)
    manifest = warc.write_archives(pages, root)
    return warc.read_archives(spark, root, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(_id_text("doc_id")) % 4 == 2
    profiles = langid.fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predict(docs, profiles).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketches.edited_pairs(_read(spark, sf_dir, "documents"))
    out = sketches.compare_versions(pairs, "text", {"edited": "near_edited", "next": "near_next"})
    named = {"id": "doc_id", "fp_text": "fingerprint", "fp_edited": "edited_fingerprint"}
    shown = out.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)}).withColumnsRenamed(named)
    return shown.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = merkle.leaf_hash(*map(F.col, merkle.FIELDS[:-1]), lower)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, other)
    return merkle.manifest(docs, tampered).withColumnRenamed("id", "doc_id")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, s)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: Control strings and their escapes, as in the template.
_OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + 24 + length(role) + len(regexp_extract_all(text, '<\\*\|turn\|>|<\\*\|text\|>|<\\*\|end\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>')) AS size FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR back = 1))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < 100 OR page_id = min(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = min(page_id) OVER (PARTITION BY digest) THEN NULL ELSE min(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM d
"""

#: Every source gets an equal share of the mixture. A rate above 64 is drawn as a sum of Poisson numbers.
_OP1_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
s AS (SELECT source, greatest(ceil(rate / 64), 1)::INTEGER AS pieces, rate / greatest(ceil(rate / 64), 1) AS rate FROM r),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM s
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1)::DOUBLE, c + p * rate / (k + 1)::DOUBLE FROM c WHERE k < ceil(rate + 10 * sqrt(rate) + 20)),
j AS (SELECT doc_id, d.source, pieces, unnest(generate_series(1, pieces)) AS j FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
u AS (SELECT doc_id, source, ('0x' || substr(md5('mix-1:' || CASE WHEN pieces > 1 THEN 'piece:' ELSE '' END || coalesce(doc_id::VARCHAR, '') || CASE WHEN pieces > 1 THEN ':' || j ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM j),
k AS (SELECT u.doc_id, count(*) FILTER (c.c <= u.u) AS k FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id),
x AS (SELECT d.*, unnest(generate_series(1, k.k::BIGINT)) AS i FROM documents d JOIN k USING (doc_id))
SELECT doc_id, text, lang, source, n_chars, i::INTEGER AS copy, ('0x' || substr(md5('mix-1:order:' || doc_id || ':' || i), 1, 13))::BIGINT AS mix_key FROM x
"""

_OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, both_ways.v FROM reach JOIN both_ways ON reach.r = both_ways.u),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT item, t, count(*) AS times FROM (SELECT item, unnest(w) AS t FROM b) GROUP BY ALL),
p AS (SELECT row, doc_id, t, n, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT row, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS part FROM p JOIN f USING (t), s),
r AS (SELECT item, doc_id, row, sum(part * times)::BIGINT AS score FROM x JOIN q USING (t) GROUP BY ALL),
k AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN b USING (item) WHERE rank <= 10
"""

#: CRC-32 of the digits of doc_id, bit by bit.
_CRC_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""


def _op12_sql(low: int = 7, high: int = 3) -> str:
    """For up to 8 ** low leaves of a language and 8 ** high languages."""
    of = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: f"sha256({of('doc_id')} || {of('source')} || {of('lang')} || {of('n_chars')} || {of(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_CRC_SQL} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
        "n0 AS (SELECT lang, p, leaf AS h FROM a0)",
    ]
    for k in range(1, low + high + 1):
        if k == low + 1:
            parts.append(f"g AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS q FROM n{low})")
            parts.append("n_low AS (SELECT 0 AS lang, q AS p, subroot AS h FROM g)")
        below = "n_low" if k == low + 1 else f"n{k - 1}"
        parts.append(f"q{k} AS (SELECT lang, p // 8 AS p, string_agg(h, '' ORDER BY p) AS s, p // 8 = 0 AND count(*) = 1 AS lone FROM {below} GROUP BY lang, p // 8)")
        parts.append(f"n{k} AS (SELECT lang, p, CASE WHEN lone THEN s ELSE sha256(s) END AS h FROM q{k})")
    cols, joins, at = [], [], "a0.p"
    for k in range(1, low + high + 1):
        own = at if k <= low else "g.q"
        shift = 8 ** ((k - 1) if k <= low else (k - low - 1))
        key = f"a0.lang IS NOT DISTINCT FROM q{k}.lang" if k <= low else f"q{k}.lang = 0"
        joins.append(f"JOIN q{k} ON {key} AND {own} // {8 * shift} = q{k}.p")
        cols.append((f"q{k}", f"(({own} // {shift}) % 8)"))
    proof = " || ".join(f"CASE WHEN {q}.lone THEN '' ELSE left({q}.s, 64 * {i}) || substr({q}.s, 64 * {i} + 65) END" for q, i in cols)
    parts.append(f"w AS (SELECT a0.doc_id, leaf, other, subroot, n{low + high}.h AS root, sha256({proof}) AS proof_sha256, " + ", ".join(f"CASE WHEN {q}.lone THEN NULL ELSE left({q}.s, 64 * {i}) END AS x{k}, substr({q}.s, 64 * {i} + 65) AS y{k}" for k, (q, i) in enumerate(cols, 1)) + f", other AS f0 FROM a0 JOIN g ON a0.lang IS NOT DISTINCT FROM g.lang {' '.join(joins)} CROSS JOIN n{low + high})")
    last = "w"
    for k in range(1, low + high + 1):
        parts.append(f"f{k} AS (SELECT *, CASE WHEN x{k} IS NULL THEN f{k - 1} ELSE sha256(x{k} || f{k - 1} || y{k}) END AS f{k} FROM {last})")
        last = f"f{k}"
    final = f"f{low + high}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, {final} AS folded_root, {final} = root AS verified FROM {final}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_html": op2_html,
    "op3_ann": op3_ann,
    "op4_chat": op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_minhash": op9_minhash,
    "op10_langid": op10_langid,
    "op11_fingerprints": op11_fingerprints,
    "op12_merkle": op12_merkle,
    "op13_lexical": op13_lexical,
}
SQL = {"op1_mix": _OP1_SQL, "op4_chat": _OP4_SQL, "op5_decontaminate": _OP5_SQL, "op8_warc": _OP8_SQL, "op9_minhash": _OP9_SQL, "op12_merkle": _op12_sql(), "op13_lexical": _OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

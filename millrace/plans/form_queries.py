"""Checked inputs, replies, speech rules, paths, rounding and prices over the tables.

Replies in JSON are composed from a row's own values, so that the SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import formats, replies, speech
from millrace.plans.common import EVENTS_SQL, events_log
from millrace.session import table


def f04_clean_question(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", formats.clean_question(F.col("text"), 300).alias("q"), formats.clean_course(F.col("role"), ["user", "system"]).alias("c"))
    return c.select("conv_id", "turn", "role", F.md5("q.question").alias("question"), "q.problem", F.col("c.course").alias("course"), F.col("c.problem").alias("course_problem"))


def f31_lists_people(spark, sf_dir):
    """Texts that list addresses or long numbers, by sure and by dense hits."""
    d = table(spark, sf_dir, "documents")
    strong, strict = F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")), F.regexp_count("text", F.lit(r"[0-9]+"))
    return d.select("doc_id", speech.lists_people(strong, strict, speech.word_count(F.col("text"))).alias("lists"))


def f36_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    image = F.concat(F.lit("/slides/"), "page_id", F.when(F.col("page_id") % 3 == 0, "-thumb.webp").when(F.col("page_id") % 3 == 1, ".webp").otherwise(".png"))
    audio = F.concat(F.lit("audio/"), "page_id", F.when(F.col("page_id") % 2 == 0, ".mp3").otherwise(".wav"))
    return p.select("page_id", formats.safe_filename(F.concat(F.lit("C:\\in box\\"), "url", F.lit(" (1)?.pdf_"))).alias("file"), formats.boxes_path(image).alias("boxes"), formats.words_path(audio).alias("words"))


def s21_sessions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("in/"), F.format_string("%05d", F.col("doc_id") % 3 + 70440), F.lit("/s"), F.format_string("%02d", F.col("doc_id") % 20), F.when(F.col("doc_id") % 7 == 0, "-old").otherwise(""), F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise("/slides.json"))
    return d.withColumn("s", formats.session_of_path(F.when(F.col("doc_id") % 11 == 0, "in/other/s1/x").otherwise(path))).groupBy(F.col("s.course").alias("course"), F.coalesce("s.session", F.lit(-1)).alias("session")).agg(F.count("*").alias("n"))


def f37_number_texts(spark, sf_dir):
    """Shares and means as texts, and shares on the rubric's scale, rounded by their exact values."""
    e = table(spark, sf_dir, "events")
    share = F.col("value") / 64
    mean = F.when(F.col("event_id") % 9 != 0, F.col("value") / 8)
    dim = F.when(F.col("event_id") % 2 == 0, "grounded").otherwise("clear")
    return e.select("event_id", formats.percent_text(share).alias("percent"), formats.number_text(F.col("value") / 8, 1).alias("number"), formats.score_text(dim, mean, F.when(F.col("event_id") % 4 == 0, F.col("event_id"))).alias("score"), formats.to_rubric(share).alias("rubric"))


def f46_round_exact(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x = F.col("l_extendedprice").cast("double") / 1000
    return l.select("l_orderkey", "l_linenumber", formats.round_exact(x, 2).alias("two"), formats.round_exact(x, 4).alias("four"))


def f48_price_guard(spark, sf_dir):
    """Parts as models: those of some brands are checked, some have no price or a variable one."""
    p = table(spark, sf_dir, "part")
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("double") / 1e8
    prompt = F.when(k % 10 == 0, None).when(k % 10 == 1, -price).otherwise(price)
    problem = formats.price_problem(k % 4 != 0, k % 6 != 0, prompt, price * 4, 12.0, 50.0)
    return p.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


def f54_cue_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = formats.seconds(F.when(F.hour("ts") > 0, F.hour("ts")), F.minute("ts"), F.second("ts"), F.col("event_id") % 1000)
    return e.select("event_id", F.round(start, 3).alias("start"), F.round(formats.midpoint(start, start + F.col("value")), 6).alias("mid"))


def f55_stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("at"))
    return e.select("event_type", formats.version_stamp(F.col("at"), F.sha2("event_type", 256)).alias("stamp"))


def r05_effective(spark, sf_dir):
    """A stored value, else one from the surroundings, else the default, with where it comes from."""
    e = events_log(spark, sf_dir)
    v = formats.effective(("settings", F.when(F.col("k") % 3 == 0, F.col("value"))), ("env", F.when(F.col("k") % 5 == 0, F.lit(0.5))), ("code", F.lit(0.52)))
    return e.groupBy("event_type", v["source"].alias("source")).agg(F.count("*").alias("n"), F.round(F.sum(v["value"]), 4).alias("total"))


def f23_speakable(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    said = F.concat(F.lit("See "), "url", F.lit(",  and www.b.example/x?y=1 —  then go.  Or "), "url", F.lit("."))
    return p.select("page_id", speech.clean_speech(speech.speakable_links(said)).alias("said"))


def f24_problems(spark, sf_dir):
    """The first reason against showing a text, for texts of which some hold something bad."""
    d = table(spark, sf_dir, "documents")
    bad = ["", "oh damn", "the quiz code is AB12 now", "ask [ Student ] about it", "see example.com", "key sk-abcdefgh1234", "mail a.b@c.org", "my name is Ann"]
    i = (F.col("doc_id") % len(bad)).cast("int")
    text = F.concat_ws(" ", F.get(F.array(*map(F.lit, bad)), i), F.substring(F.regexp_replace("text", "[^a-z ]+", ""), 1, 500))
    out = speech.answer_problem(F.when(F.col("doc_id") % 97 == 0, "").otherwise(text), 60, 450)
    return d.groupBy(i.alias("kind"), F.coalesce(out, F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def p21_clean_cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat_ws(" ", F.when(F.col("conv_id") % 6 == 0, "oh my god").when(F.col("conv_id") % 6 == 1, "[person]").when(F.col("conv_id") % 6 == 2, "F-score of hello"), F.lit("and so on"))
    ok = speech.clean_cue(text, F.col("role"), F.when(F.col("turn") == 2, True), "assistant")
    return c.groupBy("role", ok.alias("ok")).agg(F.count("*").alias("n"))


def _reply(*parts: Column | str) -> Column:
    return F.concat(F.lit("Sure:\n```json\n{"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("}\n``` Done."))


_KINDS = ("api_credits", "submission", "quiz", "odd")


def f62_classifier(spark, sf_dir):
    e = events_log(spark, sf_dir)
    flag = F.when(F.col("k") % 5 == 0, F.lit("null")).when(F.col("k") % 2 == 0, "true").otherwise("false")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("k") % 4).cast("int"))
    reply = _reply('"incident": ', flag, ', "type": "', kind, '", "course": "', (F.col("k") % 3).cast("string"), '", "item": " Lab \\t ', F.col("event_type"), ' ", "confidence": ', F.round(F.col("value") / 50, 3).cast("string"))
    out = e.select("event_id", replies.classifier(reply, ["api_credits", "submission", "quiz"], ["1", "2"]).alias("c"))
    return out.select("event_id", "c.incident", "c.kind", "c.course", "c.item", "c.confidence")


def f62_choice(spark, sf_dir):
    e = events_log(spark, sf_dir)
    reply = F.when(F.col("k") % 7 == 0, "no braces here").otherwise(_reply('"scope": "', F.col("event_type"), '", "reason": "', F.repeat(F.lit("r"), F.col("k").cast("int") * 10), '"'))
    out = replies.choice(reply, "scope", ["click", "error", "view"])
    return e.groupBy(out["value"].alias("scope")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length(out["reason"]), F.lit(0))).alias("chars"))


def f62_themes(spark, sf_dir):
    """Two themes for each event, the larger first, with examples by number."""
    e = events_log(spark, sf_dir)
    reply = _reply('"themes": [{"label": " mail  a@b.org ", "count": "', F.col("k").cast("string"), '", "examples": [1, 3, 1, 9]}, {"label": "', F.col("event_type"), '", "count": 2, "examples": []}, {"label": " "}]')
    t = replies.themes(reply, F.array(F.lit("qa"), F.lit("qb"), F.lit("qc")))
    return e.select("event_id", F.explode(F.transform(t, lambda x, i: F.struct(i.alias("place"), x["label"].alias("label"), x["count"].alias("count"), F.array_join(x["examples"], ",").alias("examples")))).alias("t")).select("event_id", "t.*")


def f64_spec_problems(spark, sf_dir):
    """Slides of bullets with something wrong in some of them."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = F.when(i % 7 == 0, "poem").otherwise("bullets")
    title = F.when(i % 5 == 0, F.repeat(F.lit("t"), 81)).when(i % 11 == 0, " ").otherwise("A title")
    bullet = F.concat(F.lit('"'), F.when(i % 13 == 0, F.repeat(F.lit("b"), 121)).when(i % 17 == 0, "oh damn").otherwise("a bullet"), F.lit('"'))
    bullets = F.array_join(F.array_repeat(bullet, (i % 4 + 2).cast("int")), ", ")
    link = F.when(i % 3 == 0, "http://a.org").otherwise("https://a.org/x")
    spec = F.concat(F.lit('{"kind": "'), kind, F.lit('", "title": "'), title, F.lit('", "bullets": ['), bullets, F.lit('], "sources": ["'), link, F.lit('"]}'))
    return e.groupBy(F.coalesce(replies.spec_problem(spec), F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def f66_record_problems(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    line = F.concat(
        F.lit('{"question": "'), F.when(i % 17 == 0, "  ").when(i % 13 == 0, "write to a@b.org").otherwise("What is it?"), F.lit('", "category": "'), F.col("event_type"), F.lit('", "month": "'), F.when(i % 11 == 0, "2026-1").otherwise("2026-01"),
        F.lit('", "type": "'), F.when(i % 7 == 0, "riddle").otherwise("concept"), F.lit('", "expected_slides": ["70445-s06-0'), (i % 100).cast("string"), F.lit('"], "must_not": ["'), F.when(i % 5 == 0, "12345678").otherwise("no"), F.lit('"]}'),
    )
    problem = replies.record_problem(line, ["CLICK", "VIEW", "ERROR", "PURCHASE"], ["concept", "beyond"])
    return e.groupBy(F.coalesce(problem, F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def f71_alignment_words(spark, sf_dir):
    e = events_log(spark, sf_dir)
    reply = F.concat(F.lit('{"words": [{"text": " '), F.col("event_type"), F.lit(' ", "start": '), F.col("value").cast("string"), F.lit('}, {"text": " ", "start": 1.5}, {"text": "late"}, {"text": "end", "start": '), F.col("k").cast("string"), F.lit("}]}"))
    return e.select("event_id", F.posexplode(replies.alignment_words(reply)).alias("place", "w")).select("event_id", "place", "w.start", "w.word")


def u08_unpriced(spark, sf_dir):
    """For each user the kinds of event that their price table lacks, sorted."""
    e = events_log(spark, sf_dir)
    prices = e.filter("value >= 90").select("event_type", "user_id").distinct()
    bare = e.join(prices, ["event_type", "user_id"], "left_anti")
    return bare.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("unpriced"))


def o04_by_cost(spark, sf_dir):
    """Kinds of event in the order of what they cost, the dearest first."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("cost"))
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cost"), "event_type")))  # a row for each kind


def r02_responses(spark, sf_dir):
    """What judges see of answers of several kinds, by status and source."""
    e = events_log(spark, sf_dir)
    kind = F.when(F.col("k") % 5 == 0, "web").when(F.col("k") % 5 == 1, "faq").when(F.col("k") % 5 == 2, "logistics").when(F.col("k") % 5 == 3, "stored_topic")
    r = replies.response(kind, F.col("value") >= 50, F.col("k") % 3, F.repeat(F.lit("words "), 130), F.concat(F.lit("see "), F.col("event_type")))
    out = e.select(r.alias("r")).select("r.*")
    return out.groupBy("status", "outcome", "source").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("message"), F.lit(0))).alias("chars"))


def o07_sending_order(spark, sf_dir):
    """The order in which files are sent, by turn and path, for each source."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = F.concat("source", F.when(i % 50 == 0, "/manifest.json").when(i % 10 == 0, "/index/part").when(i % 10 == 1, "/topics.json").otherwise("/slides/a.webp"))
    turn = formats.sending_turn(path)
    return d.select("source", "doc_id", turn.alias("turn"), F.row_number().over(Window.partitionBy("source").orderBy(turn, path, "doc_id")).alias("place"))


def f61_judgements(spark, sf_dir):
    """Replies of a judge of every labelled document, made of its numbers and text: bare, fenced or cut short."""
    d = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    scores = F.struct((n % 7).alias("style"), F.when(n % 9 < 8, n % 9 / 2).alias("depth"))
    verdict = F.when(F.col("quality") == 1, "Pass ").when(n % 13 == 0, F.col("lang")).otherwise("fail")
    issues = F.when(n % 3 == 0, F.to_json(F.struct(F.col("text").alias("issues")))).otherwise(F.to_json(F.struct(F.split("text", "\n").alias("issues"))))
    body = F.concat(F.regexp_replace(F.to_json(F.struct(scores.alias("scores"), verdict.alias("verdict"), F.col("text").alias("rationale"))), r"\}$", ""), F.lit(","), F.regexp_replace(issues, r"^\{", ""))
    body = F.when(F.col("text").isNull(), F.to_json(F.struct(scores.alias("scores"), verdict.alias("verdict")))).otherwise(body)
    reply = F.when(n % 10 == 3, F.regexp_replace(body, r"\}$", "")).when(n % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    r = d.select("doc_id", replies.judgement(reply, ["style", "depth"]).alias("r"))
    return r.select("doc_id", "r.problem", F.col("r.scores.style").cast("double").alias("style"), F.col("r.scores.depth").cast("double").alias("depth"), "r.verdict", F.md5("r.rationale").alias("rationale"), F.coalesce(F.size("r.issues"), F.lit(-1)).alias("n_issues"), F.md5(F.array_join("r.issues", "|")).alias("issues"))


QUERIES = {
    f.__name__: f
    for f in (
        f04_clean_question, f31_lists_people, f36_paths, s21_sessions, f37_number_texts, f46_round_exact, f48_price_guard, f54_cue_times, f55_stamps, r05_effective, f23_speakable, f24_problems, p21_clean_cues, f62_classifier, f62_choice, f62_themes,
        f64_spec_problems, f66_record_problems, f71_alignment_words, u08_unpriced, o04_by_cost, r02_responses, o07_sending_order, f61_judgements,
    )
}
_FMT = "format('{{:.2f}}', {})::DOUBLE"
SQL = {
    "f04_clean_question": r"""WITH q AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS q FROM conversations)
SELECT conv_id, turn, role, CASE WHEN q <> '' AND length(q) <= 300 THEN md5(q) END AS question, CASE WHEN q = '' THEN 'empty' WHEN length(q) > 300 THEN 'too long' END AS problem,
  CASE WHEN role IN ('user', 'system') THEN role END AS course, CASE WHEN role NOT IN ('user', 'system', '', 'all') THEN 'unknown' END AS course_problem FROM q""",
    "f31_lists_people": r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS a, len(regexp_extract_all(text, '[0-9]+')) AS b, len(regexp_extract_all(text, '\S+')) AS w FROM documents)
SELECT doc_id, a >= 3 OR (b >= 6 AND b > 0.02 * greatest(w, 1)) AS lists FROM c""",
    "f36_paths": r"""SELECT page_id, left(trim(regexp_replace(regexp_extract(url, '[^/]*$') || ' (1)?.pdf_', '[^A-Za-z0-9._-]+', '_', 'g'), '._'), 120) AS file,
  CASE WHEN page_id % 3 = 1 THEN 'slides/' || page_id || '.boxes.json' END AS boxes, CASE WHEN page_id % 2 = 0 THEN 'audio/' || page_id || '.words.json' END AS words FROM pages""",
    "s21_sessions": """WITH s AS (SELECT doc_id % 11 <> 0 AS ok, doc_id FROM documents)
SELECT CASE WHEN ok THEN (doc_id % 3 + 70440)::VARCHAR END AS course, CASE WHEN ok THEN doc_id % 20 ELSE -1 END::INTEGER AS session, count(*) AS n FROM s GROUP BY ALL""",
    "f37_number_texts": f"""WITH e AS (SELECT event_id, value / 64 AS share, value / 8 AS v, CASE WHEN event_id % 9 <> 0 THEN value / 8 END AS mean FROM events)
SELECT event_id, round_even(share * 100, 0)::BIGINT || '%' AS percent, format('{{:.1f}}', v) AS number,
  CASE WHEN mean IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'n/a (no slides)' ELSE 'n/a' END ELSE format('{{:.2f}}', mean) || CASE WHEN event_id % 4 = 0 THEN ' (n=' || event_id || ')' ELSE '' END END AS score,
  {_FMT.format("1 + 4 * share")} AS rubric FROM e""",
    "f46_round_exact": "SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice::DOUBLE / 1000)::DOUBLE AS two, format('{:.4f}', l_extendedprice::DOUBLE / 1000)::DOUBLE AS four FROM lineitem",
    "f48_price_guard": """WITH p AS (SELECT p_partkey AS k, p_retailprice::DOUBLE / 1e8 * 1000000 AS d, p_retailprice::DOUBLE / 1e8 * 4 * 1000000 AS c FROM part)
SELECT CASE WHEN k % 4 = 0 THEN 'ok' WHEN k % 6 = 0 THEN 'not listed' WHEN k % 10 = 0 THEN 'no fixed price' WHEN k % 10 = 1 THEN 'variable price' WHEN d > 12 OR c > 50 THEN 'too dear' ELSE 'ok' END AS problem, count(*) AS n FROM p GROUP BY 1""",
    "f54_cue_times": """WITH s AS (SELECT event_id, value, hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (event_id % 1000) / 1000 AS s FROM events) SELECT event_id, round(s, 3) AS start, round(s + value / 2, 6) AS mid FROM s""",
    "f55_stamps": "SELECT event_type, strftime(max(ts), '%Y%m%dT%H%M%SZ') || '-' || left(sha256(event_type), 8) AS stamp FROM events GROUP BY 1",
    "r05_effective": f"""WITH {EVENTS_SQL}, v AS (SELECT event_type, CASE WHEN k % 3 = 0 THEN 'settings' WHEN k % 5 = 0 THEN 'env' ELSE 'code' END AS source, CASE WHEN k % 3 = 0 THEN value WHEN k % 5 = 0 THEN 0.5 ELSE 0.52 END AS v FROM e)
SELECT event_type, source, count(*) AS n, round(sum(v), 4) AS total FROM v GROUP BY ALL""",
    "f23_speakable": "SELECT page_id, 'See the links on the slide, then go. Or the link on the slide.' AS said FROM pages",
    "f24_problems": """WITH d AS (SELECT doc_id, doc_id % 8 AS kind, left(regexp_replace(text, '[^a-z ]+', '', 'g'), 500) AS rest FROM documents),
b AS (SELECT *, ['', 'oh damn', 'the quiz code is AB12 now', 'ask [ Student ] about it', 'see example.com', 'key sk-abcdefgh1234', 'mail a.b@c.org', 'my name is Ann'][kind + 1] || ' ' || rest AS t FROM d),
c AS (SELECT *, len(regexp_extract_all(t, '[^ ]+')) AS words,
  regexp_matches(rest, '(^|[^a-z])(fu+ck|motherf|shit|bullshit|damn|dammit|goddam|bitch|bastard|asshole|jackass|dumbass|cunt|slut|whore|(piss|pissed|pissing|dick|dicks|cock|cocks|wtf)($|[^a-z]))') AS crude FROM b)
SELECT kind::INTEGER AS kind, CASE WHEN doc_id % 97 = 0 THEN 'empty' WHEN words > 60 THEN 'too many words' WHEN length(t) > 450 THEN 'too many characters' WHEN kind IN (4, 6) THEN 'web address' WHEN kind = 1 OR crude THEN 'crude word'
  WHEN kind = 2 THEN 'access code' WHEN kind = 3 THEN 'name token' WHEN kind = 5 THEN 'key or token' WHEN kind = 7 THEN 'personal detail' ELSE 'none' END AS problem, count(*) AS n FROM c GROUP BY ALL""",
    "p21_clean_cues": "SELECT role, role = 'assistant' AND conv_id % 6 NOT IN (0, 1) AND turn <> 2 AS ok, count(*) AS n FROM conversations GROUP BY ALL",
    "f62_classifier": f"""WITH {EVENTS_SQL}, c AS (SELECT event_id, k, event_type, k % 5 <> 0 AS ok, round(value / 50, 3) AS v FROM e)
SELECT event_id, CASE WHEN ok THEN k % 2 = 0 END AS incident, CASE WHEN ok AND k % 4 < 3 THEN ['api_credits', 'submission', 'quiz'][k % 4 + 1] END AS kind, CASE WHEN ok AND k % 3 > 0 THEN (k % 3)::VARCHAR END AS course,
  CASE WHEN ok THEN 'Lab ' || event_type END AS item, CASE WHEN ok THEN least(greatest(v, 0), 1) END AS confidence FROM c""",
    "f62_choice": f"""WITH {EVENTS_SQL}, c AS (SELECT k, CASE WHEN k % 7 <> 0 AND event_type IN ('click', 'error', 'view') THEN event_type END AS scope FROM e)
SELECT scope, count(*) AS n, sum(CASE WHEN scope IS NOT NULL THEN least(k * 10, 200) ELSE 0 END)::BIGINT AS chars FROM c GROUP BY 1""",
    "f62_themes": f"""WITH {EVENTS_SQL}, t AS (SELECT event_id, 'mail [email]' AS label, least(k, 3) AS count, 'qa,qc' AS examples, 0 AS i FROM e UNION ALL SELECT event_id, event_type, 2, '', 1 FROM e)
SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY count DESC, i) - 1)::INTEGER AS place, label, count::INTEGER AS count, examples FROM t""",
    "f64_spec_problems": """SELECT CASE WHEN i % 7 = 0 THEN 'unknown kind' WHEN i % 5 = 0 THEN 'title is too long' WHEN i % 11 = 0 THEN 'title is empty' WHEN i % 4 + 2 NOT BETWEEN 3 AND 5 THEN 'wrong number of bullets' WHEN i % 13 = 0 THEN 'bullet is too long'
  WHEN i % 17 = 0 THEN 'bullet: crude word' WHEN i % 3 = 0 THEN 'sources must be https links' ELSE 'none' END AS problem, count(*) AS n FROM (SELECT event_id AS i FROM events) GROUP BY 1""",
    "f66_record_problems": """SELECT CASE WHEN i % 17 = 0 THEN 'question is empty' WHEN upper(event_type) NOT IN ('CLICK', 'VIEW', 'ERROR', 'PURCHASE') THEN 'unknown category' WHEN i % 11 = 0 THEN 'month must be YYYY-MM' WHEN i % 13 = 0 THEN 'question leaks'
  WHEN i % 7 = 0 THEN 'unknown type' WHEN i % 100 < 10 THEN 'expected_slides must be slide ids' WHEN i % 5 = 0 THEN 'must_not leaks' ELSE 'none' END AS problem, count(*) AS n FROM (SELECT event_id AS i, event_type FROM events) GROUP BY 1""",
    "f71_alignment_words": f"WITH {EVENTS_SQL} SELECT event_id, 0 AS place, value AS start, event_type AS word FROM e UNION ALL SELECT event_id, 1, k, 'end' FROM e",
    "u08_unpriced": "WITH p AS (SELECT DISTINCT event_type, user_id FROM events WHERE value >= 90) SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS unpriced FROM events e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.event_type = e.event_type AND p.user_id = e.user_id) GROUP BY 1",
    "r02_responses": f"""WITH {EVENTS_SQL}, a AS (SELECT CASE k % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'faq' WHEN 2 THEN 'logistics' WHEN 3 THEN 'stored_topic' END AS outcome, value >= 50 AS covered, k % 3 > 0 AS shown, event_type FROM e),
s AS (SELECT outcome, event_type, CASE WHEN outcome = 'web' OR covered THEN 'ok' ELSE 'not_covered' END AS status, CASE WHEN outcome = 'web' THEN 'web' WHEN covered AND NOT shown THEN coalesce(outcome, 'answer') END AS source FROM a)
SELECT status, outcome, source, count(*) AS n, sum(CASE WHEN status = 'ok' THEN 0 WHEN outcome = 'faq' THEN 12 + 695 WHEN outcome = 'logistics' THEN 10 + 4 + length(event_type) ELSE 0 END)::BIGINT AS chars FROM s GROUP BY ALL""",
    "o07_sending_order": """WITH p AS (SELECT source, doc_id, CASE WHEN doc_id % 50 = 0 THEN 3 WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS turn FROM documents)
SELECT source, doc_id, turn, row_number() OVER (PARTITION BY source ORDER BY turn, doc_id)::INTEGER AS place FROM p""",
    "o04_by_cost": "SELECT event_type, cost, row_number() OVER (ORDER BY cost DESC, event_type)::INTEGER AS place FROM (SELECT event_type, round(sum(value), 4) AS cost FROM events GROUP BY 1)",
    "f61_judgements": r"""WITH b AS (SELECT doc_id, quality, text, lang, n_chars AS n, n_chars % 7 AS style, CASE WHEN n_chars % 9 < 8 THEN round_even((n_chars % 9) / 2.0::DOUBLE, 0)::INTEGER END AS depth FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, CASE WHEN n % 10 = 3 THEN 'reply is not JSON' WHEN style NOT BETWEEN 1 AND 5 THEN 'score style is outside 1 to 5' WHEN depth NOT BETWEEN 1 AND 5 THEN 'score depth is outside 1 to 5'
  WHEN quality <> 1 AND n % 13 = 0 THEN 'verdict must be pass or fail' END AS problem, CASE WHEN text IS NULL OR (n % 3 = 0 AND text = '') THEN []::VARCHAR[] WHEN n % 3 = 0 THEN [text] ELSE string_split(text, chr(10)) END AS raw FROM b),
s AS (SELECT *, list_transform(raw[1:8], lambda i: trim(regexp_replace(i, '\s+', ' ', 'g'))) AS lines, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM p),
c AS (SELECT *, list_transform(lines, lambda i: CASE WHEN length(i) <= 200 THEN i ELSE i[1:199] || '…' END) AS cut FROM s)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN style::DOUBLE END AS style, CASE WHEN problem IS NULL THEN depth::DOUBLE END AS depth, CASE WHEN problem IS NULL THEN CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END END AS verdict,
  CASE WHEN problem IS NULL THEN md5(CASE WHEN length(t) <= 600 THEN t ELSE t[1:599] || '…' END) END AS rationale, CASE WHEN problem IS NULL THEN len(cut) ELSE -1 END::INTEGER AS n_issues, CASE WHEN problem IS NULL THEN md5(array_to_string(cut, '|')) END AS issues FROM c""",
}

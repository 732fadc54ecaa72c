"""The query functions themselves: columns, held-out rules, whole tables; and cases that scale brings."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, decontaminate, langid, linking, minhash, mixing, queries, toxicity, warc
from millrace.llm.common import BLANK_WORD, PLAIN_WORD, Words, byte_table, first_by_hash, lower_ascii, shared_dir
from tests.conftest import SMALL, rows_of
from tests.llm.test_pair_operators import near_copies, shingles, union_find


def rows_in(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_ann_query(spark):
    out = queries.op3_ann(spark, SMALL)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows_in(spark, "embeddings").collect()}
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = {i: float(np.sqrt(((v - vectors[q]) ** 2).sum())) for i, v in vectors.items() if i != q}
        assert [r["rank"] for r in found] == list(range(1, min(10, len(d)) + 1))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in found)
        hits += len({r["vec_id"] for r in found} & set(sorted(d, key=lambda i: (d[i], i))[:10]))
    assert hits / sum(map(len, got.values())) >= 0.95


def test_line_query(spark):
    out = queries.op6_line_dedup(spark, SMALL)
    docs = {r["doc_id"]: r["text"] for r in rows_in(spark, "documents").collect()}
    rows = out.collect()
    assert out.columns == ["doc_id", "n_lines", "n_removed", "text"] and len(rows) == len(docs)
    for r in rows:
        before = [x for x in (docs[r["doc_id"]] or "").split("\n") if x.strip(" \t\r\x0b\f")]
        after = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\r\x0b\f")]
        assert r["n_lines"] == len(before) and r["n_removed"] == len(before) - len(after)


@pytest.mark.parametrize("name, parts, rest", [("op7_toxicity", 5, 0), ("op10_langid", 4, 2)])
def test_held_out_rules(spark, name, parts, rest):
    out = queries.QUERIES[name](spark, SMALL)
    rows = out.collect()
    assert len(rows) == rows_in(spark, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op7_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows) and dict(out.dtypes)["predicted"] == "int"
    else:
        truth = {r["doc_id"]: r for r in rows_in(spark, "documents").collect()}
        told = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
        assert np.mean(told) >= 0.9


def test_langid_fit_where_most_tasks_hold_nothing(spark):
    rows = [(i, "ein Satz mit Wörtern" if i % 2 else "a sentence with words", "de" if i % 2 else "en") for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16)
    assert langid.fit(train, max_per_lang=2).langs == ["de", "en"]
    tied = train.unionByName(train)  # repeated rows and ties of ids
    again = langid.fit(tied, max_per_lang=2)
    assert np.allclose(again.unit, langid.fit(train, max_per_lang=2).unit, atol=1e-5)


def test_first_by_hash_is_a_fixed_sample(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    once, again = (sorted(map(tuple, first_by_hash(rows.repartition(n), "g", "i", 7, 1).collect())) for n in (3, 11))
    assert once == again and len(once) == 21


@pytest.mark.parametrize("most", [10**6, 0])
def test_items_without_an_id(spark, most):
    bench = spark.createDataFrame([(None, "some words that are here"), (4, "never there at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "these are some words that are here today"), (2, "these are some words that are here today"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["report"] for r in decontaminate.scan(docs, bench, max_windows=most).collect()}
    for i in (1, 2):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (8, 5, 1, hashlib.sha256(b"").hexdigest())
    assert got[3]["n_words"] == got[3]["n_hit"] == 0


@pytest.mark.parametrize("pattern", [PLAIN_WORD, BLANK_WORD])
def test_words_in_bytes_are_those_of_the_pattern(pattern):
    rng = np.random.default_rng(0)
    letters = list("abAZ09 _.\n\t\r\x0b\x0c\x00éßЖ中😀`{")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(300)] + [None, "", "x" * 5000, "y" * 65, "x" * 5000 + " Y" * 3]
    words = Words(texts, byte_table(pattern))
    seen = {}
    for i, t in enumerate(texts):
        want = pattern.findall(lower_ascii(t)) if t else []
        a, b = words.first[i], words.first[i + 1]
        assert [words.word(j).decode() for j in range(a, b)] == want
        for w, h in zip(want, words.hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_scores_equal_a_loop_over_windows(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(rng.choice(list("abcdef"), rng.integers(1, 4))) for _ in range(n))
    texts = [text(int(n)) for n in rng.integers(0, 300, 60)]
    net = toxicity.train(texts, [i % 2 for i in range(60)], steps=4)
    scorer = toxicity.Scorer(net)
    scorer.block = 7
    got = scorer.score([*texts, None, texts[0]])
    for t, s in zip([*texts, None, texts[0]], got, strict=True):
        words, best = toxicity.words_of(t), -np.inf
        for at in toxicity.windows_of(len(words)):
            part = words[at : at + toxicity.WINDOW]
            kinds = sorted(set(part)) or ["_"]
            pre = net.project(net.inputs(kinds)[0])
            row = np.array([[kinds.index(w) for w in part] or [len(kinds)]])
            best = max(best, float(net.forward(pre, row)[0]))
        assert s == pytest.approx(1 / (1 + np.exp(-best)), abs=1e-5)


def test_toxicity_fit_bounds_and_repeats(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(40)] + [(0, "good word"), (100, "w" * 9000), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 1), (0, 0), (None, 1), (7, None)], "doc_id long, toxic long")
    model = toxicity.fit(docs, labels, F.lit(True), most=5)
    assert isinstance(model, toxicity.Network)


def test_mixture_of_rare_sources_equals_its_sql(spark, tmp_path):
    rows = [(i, "t", "en", "rare" if i < 3 else "few" if i < 40 else "most", 1) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op1_mix(spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(con.execute(queries.SQL["op1_mix"]).fetch_df())
    assert got[got.source == "rare"].groupby("doc_id").size().min() > 500


def test_chunks_of_copies_give_the_same_copies(spark, monkeypatch):
    df = spark.createDataFrame([(i, "rare" if i < 2 else "most") for i in range(300)], "doc_id long, source string")
    want = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "CHUNK_COPIES", 7)
    assert sorted(map(tuple, mixing.mix(df).collect())) == want


def test_archives_are_read_by_as_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'x' * 3000}{i * 7919}</p>") for i in range(60)] + [(99, "http://l", "long " * 400_000)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", roll_bytes=400)
    files = manifest.count()
    out = warc.read_archives(spark, f"file://{tmp_path}/w", manifest)
    assert files > 8 and out.rdd.getNumPartitions() == files and out.count() == 61
    assert not (tmp_path / "w" / "_temporary").exists()


def test_large_mixed_buckets_are_not_squared(spark):
    """50,000 members under two centres: only the smaller side is copied to the blocks."""
    n, few = 50_000, 900
    c = F.when(F.col("id") < few, F.lit(0)).otherwise(F.lit(few))
    mixed = spark.range(n).select(F.lit(1).alias("key"), "id", c.cast("long").alias("c"), F.lit(n).cast("long").alias("size"), F.struct(F.lit(n - few).cast("long").alias("n"), F.lit(few).cast("long").alias("c")).alias("big"))
    dealt = linking.in_blocks(mixed)
    assert dealt.count() <= 2 * n
    assert dealt.groupBy("a", "b").count().agg(F.max("count")).first()[0] <= 2.5 * linking.BLOCK


def test_groups_of_blocks_meet_every_pair_of_components(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 4)
    rows = [(1, i, 0 if i < 20 else i % 3, 40) for i in range(40)]
    big = max((sum(r[2] == c for r in rows), c) for c in (0, 1, 2))
    mixed = spark.createDataFrame(rows, "key long, id long, c long, size long").withColumn("big", F.struct(F.lit(big[0]).cast("long").alias("n"), F.lit(big[1]).cast("long").alias("c")))
    groups = {}
    for r in linking.in_blocks(mixed).collect():
        groups.setdefault((r["a"], r["b"]), set()).add((r["id"], r["block"], r["c"]))
    met = {}
    for (a, b), held in groups.items():
        for i, x, c in held:
            for j, y, d in held:
                if i < j and c != d and (a == b or x != y):
                    met[i, j] = met.get((i, j), 0) + 1
    want = {(i, j) for _, i, c, _ in rows for _, j, d, _ in rows if i < j and c != d}
    assert set(met) == want and set(met.values()) == {1}


def test_estimates_that_fail_do_not_hide_links(spark, monkeypatch):
    """With 16 hashes of each set estimates are often wrong; links stay exact."""
    monkeypatch.setattr(linking.link, "__defaults__", (linking.as_hashes, 2, 16))
    rows = list(enumerate(near_copies(21)))
    sets = {i: shingles(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == union_find(sets, links)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(type("S", (), {"sparkContext": Context()})())


def test_frames_choose_a_precision_that_tells_neighbours_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    assert ann.Frame(x).dtype == np.float32 and ann.Frame(x + 1e4).dtype == np.float32
    far = x.copy()
    far[::2] += 1e8
    assert ann.Frame(far).dtype == np.float64

"""Operators over tables: preferences, top-k, surrogates, mix, archives; SQL queries; the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from farebox.llm import chat, mixing, pii, quality, topk, warc
from farebox.llm.common import table
from farebox.llm.oracle import oracle_sql
from farebox.llm.queries import QUERIES
from oracle import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    assert compare.differences(QUERIES[name](spark, tiny), compare.connect(tiny), oracle_sql()[name]) == []


def test_preferences(spark):
    turns = spark.createDataFrame([
        (0, 0, "system", "be"), (0, 1, "user", "hi <|im_end|>"), (0, 2, "assistant", "yo"), (1, 0, "system", "be"),
        (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "no"), (1, 3, "user", "ok"), (2, 0, None, None),
        (4, 0, "user", "z"), (5, 0, "user", "z"), (None, 0, "a", "b")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 1), (2, 9), (4, 5)], "chosen_id long, rejected_id long")
    got = {r.chosen_id: r for r in chat.preferences(turns.withColumn("n", F.lit(1)), pairs).collect()}
    one = got[0]
    assert one.shared_turns == 2 and one.prompt.count("<|im_end|>") == 2 and "<\\|im_end|>" in one.prompt
    assert [one.chosen[a:b] for a, b in one.chosen_mask] == ["yo<|im_end|>"]
    assert [one.rejected[a:b] for a, b in one.rejected_mask] == ["no<|im_end|>"]
    assert one.rejected.endswith("ok<|im_end|>\n")
    assert got[2].rejected == "" and got[2].chosen == "<|im_start|>user\n<|im_end|>\n" and got[2].chosen_mask == []
    assert (got[4].shared_turns, got[4].chosen, got[4].rejected) == (1, "", "")
    assert chat.corpus_pairs(turns).count() == 2  # 0-1 by opening and as neighbours, 4-5 alike
    assert chat.preferences(turns.where("false"), chat.corpus_pairs(turns.where("false"))).count() == 0


def test_hot_opening_and_text_ids(spark):
    turns = spark.range(3_000).selectExpr("cast(id as string) as conv_id", "0 as turn", "'user' as role",
                                          "if(id % 3 = 0, 'hot', concat('t', id div 2)) as text")
    turns = turns.unionByName(spark.createDataFrame([("x", 0, "user", "odd")], turns.schema))
    got = {(r.chosen_id, r.rejected_id) for r in chat.corpus_pairs(turns).collect()}
    text = {str(i): "hot" if i % 3 == 0 else f"t{i // 2}" for i in range(3_000)} | {"x": "odd"}
    leader = {}
    for c in sorted(text):
        leader.setdefault(text[c], c)
    assert got == {(leader[t], c) for c, t in text.items() if leader[t] != c} | {(str(i), str(i + 1)) for i in range(0, 3_000, 2)}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 12)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [
        (300, None, 0), (301, [None] * 12, 0), (302, [float("nan")] * 12, 0), (303, [float("inf")] * 12, 0), (None, [1.0] * 12, 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(topk.vectors(df), F.col("vec_id") % 50 == 0, block=64, group=3).toPandas()
    z = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 300, 50):
        s = z @ z[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == best and mine.score.tolist() == [s[i] for i in best]
    assert topk.top_k(topk.vectors(df.where("vec_id < 1")), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(topk.vectors(df.where("false")), F.col("vec_id") == 0).count() == 0


def test_top_k_hands_out_queries_in_bounded_rounds(spark, monkeypatch):
    """The driver holds the queries of one round; no vector is copied for the pairs of a block and a group."""
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (400, 8))
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(float).tolist())], "vec_id long, v array<double>")
    context, handed = type(spark.sparkContext), []
    send = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: handed.append(sum(len(who) for who, _ in value)) or send(self, value))
    monkeypatch.setattr(topk, "ROUND", 2 * 10 * 8 * (8 + 24 * topk.K))  # of groups of ten queries, two are held at once
    best = topk.top_k(df, F.col("vec_id") % 4 == 0, block=64, group=10)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert len(handed) == 5 and sum(handed) == 100
    want = []
    for q in range(0, 400, 4):
        s = x @ x[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:topk.K]
        want += [(q, rank, i, int(s[i])) for rank, i in enumerate(order, 1)]
    assert sorted(tuple(r) for r in best.collect()) == want


def test_bands_stop_on_proof_with_the_rows_of_a_full_scan():
    """Clustered rows stop early, spread ones go through every band, and neither misses a row."""
    rng = np.random.default_rng(6)
    spread = rng.integers(-120, 120, (900, 16))
    near = np.repeat(rng.integers(-2000, 2000, (30, 16)), 30, axis=0) + rng.integers(-2, 3, (900, 16))
    for x in (spread, near, np.zeros((9, 3), dtype=np.int64), spread[:4]):
        ids = rng.permutation(len(x)) * 3
        index = topk.Index(ids, x)
        asked, own = x[::7], np.where(np.arange(len(x))[::7] % 2, ids[::7], -1)
        for j, some, score in index.search(asked, own):
            s = x @ asked[j]
            want = sorted((-int(v), int(i)) for v, i in zip(s, ids) if i != own[j])[:topk.K]
            assert [(-int(v), int(i)) for v, i in zip(score, some)] == want


def test_scores_of_any_finite_vector_are_exact(spark):
    """A component of 5e6 beside small ones, sums beyond 64 bits, and 32-bit floats near their end."""
    rng = np.random.default_rng(11)
    data = [rng.normal(size=64).tolist() for _ in range(120)]
    data += [[5e6] + [0.1] * 63, [2.0 ** 21] * 64, [-(2.0 ** 21)] * 64, [2.0 ** 21] * 63 + [2.0 ** 21 + 1], [3e38] * 64, [1e9, -1e9] * 32]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(topk.vectors(df), F.col("vec_id") % 3 == 0, block=32, group=8).orderBy("query_id", "rank").collect()]
    whole = [[int(np.floor(256 * x)) for x in v] for v in data]
    want = []
    for q in range(0, len(data), 3):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in range(len(data)) if c != q)
        want += [(q, r + 1, c, -s if abs(s) < 1 << 63 else None) for r, (s, c) in enumerate(scored[:5])]
    assert got == want


def test_surrogates(spark):
    rows = [(1, "Mail Jo.Smith-9@Mail.example.com or +1 (017) 555-7713, 4111 1111 1111 1111 and 4245100581169930; ip 10.2.3.4!!"),
            (2, "Mrs. Anna Brown met Mr. Brown. JO.SMITH-9@MAIL.EXAMPLE.COM Г-н Иванов"), (3, None), (4, ""),
            (5, 'token = "04dbebab91ab85687d33eeaaf9ab85687d33eeaa" 123-45-6789 plain 12 text'), (None, "x 1.2.3.4 y"),
            (6, "nothing here. Version 2.0, 1998"), (2, "Mrs. Anna Brown met Mr. Brown. JO.SMITH-9@MAIL.EXAMPLE.COM Г-н Иванов")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_d", F.lit(1)).withColumn("i", F.lit(2))
    out = pii.replace_entities(df, count="n")
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 8 and out.columns == ["doc_id", "text", "_d", "i", "n"]
    one = re.fullmatch(r"Mail (\S+) or \+1 \(\d{3}\) \d{3}-\d{4}, (\d{4} \d{4} \d{4} \d{4}) and \d{16}; ip (\d+\.\d+\.\d+\.\d+)!!", got[1].text)
    assert one and one[1].lower() != "jo.smith-9@mail.example.com" and one[3] != "10.2.3.4"
    digits = [int(c) for c in one[2].replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    two = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)\. (\S+) Г-н ([А-Яа-я]+)", got[2].text)
    assert two[1].endswith("na") and two[2] == two[3] != "Brown" and two[4].lower() == one[1].lower() and two[5] != "Иванов"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4} plain 12 text', got[5].text) and "04dbebab" not in got[5].text
    assert got[3].text is None and got[4].text == "" and got[6].text == rows[6][1] and "1.2.3.4" not in got[None].text
    assert [got[k].n for k in (1, 2, 3, 4, 5, 6, None)] == [5, 4, 0, 0, 2, 0, 1]
    assert pii.replace_entities(df.where("false")).count() == 0


def test_names_agree_in_every_spelling_and_without_title(spark):
    texts = ["Mr. John Smith came. Smith said: John Smith's smith, SMITH. Smithson", "Mr. McDonald, Mr. McGregor", "Mr. O'Brien; Dr. SMITH",
             "Mr. J. Smith, Mr. J.R. Smith and Mr.  Smith or Mr.\nSmith", "Frau Schmidt Kinder; Frau Schmidt. Schmidt",
             "Herr Prof. Dr. Schmidt Frau Weber, Smith", "Mrs. Kim Lee", "Mr. Kim Lee, Mrs. Anna Lee"]
    out = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count="n")
    new = {r.doc_id: r.text for r in out.collect()}
    john, smith = re.match(r"Mr\. (\w+) (\w+) came", new[0]).groups()
    assert john.endswith("n") and "Smith" not in (john, smith)
    assert new[0] == f"Mr. {john} {smith} came. {smith} said: {john} {smith}'s smith, {smith.upper()}. Smithson"
    one, two = re.fullmatch(r"Mr\. (\w+), Mr\. (\w+)", new[1]).groups()
    assert one != two and not {"McDonald", "McGregor", "Donald", "Gregor"} & {one, two}
    assert re.fullmatch(rf"Mr\. [A-Z][a-z]+; Dr\. {smith.upper()}", new[2])
    assert re.fullmatch(rf"Mr\. [A-Z]\. {smith}, Mr\. [A-Z]\.[A-Z]\. {smith} and Mr\.  {smith} or Mr\.\n{smith}", new[3])
    schmidt = re.match(r"Frau (\w+) (\w+);", new[4])[1]
    assert schmidt != "Schmidt" and new[4].endswith(f"; Frau {schmidt}. {schmidt}")
    assert re.fullmatch(rf"Herr Prof\. Dr\. {schmidt} Frau (?!Weber)\w+, Smith", new[5])  # no Smith is titled in this text
    kim, lee = re.fullmatch(r"Mrs\. (\w+) (\w+)", new[6]).groups()
    assert re.fullmatch(rf"Mr\. {kim} {lee}, Mrs\. (?!Anna)\w+na {lee}", new[7]) and kim != "Kim"


def test_numbers_and_secrets_are_found_whole(spark):
    numbers = ["+33 1 23 45 67 89", "+44 20 71 23 45 67", "+44 20 71 23 45 68", "+49 30 12 34 56 78", "+49 30 12 34 56 79", "+1 (555) 010-1234",
               "+1 2 3 4 5 6 7 8", "+44 (0)20 7123 4567", "(+44) 20 7123 4567", "+498912345678901", "3782 822463 10005", "3782-822463-10013",
               "+49 30 123456 4111 1111 1111 1111"]
    rows = [(i, f"call {n}. (or {n}) by {n}, 5 times") for i, n in enumerate(numbers)]
    rows += [(50, """{"password": "abcdefghij12", 'token' : 'abcdefghij34'}"""), (51, "sum +1 234, 4 + 5, +12 345 (678)")]
    new = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    seen = set()
    for i, n in enumerate(numbers):
        inside = n[1:] if n.startswith("(") else n
        one = re.match(r"call (.+?)\. ", new[i].text)[1]
        assert new[i].text == f"call {one}. (or {one}) by {one}, 5 times" and new[i].n == (6 if n.endswith("1111") else 3), n
        assert re.sub(r"\d", "0", one) == re.sub(r"\d", "0", n) and inside.split(" ", 1)[-1] not in one and one not in seen
        seen.add(one)
        if n.startswith("3782") or n.startswith("+33"):
            assert one[-5:] != n[-5:]
    luhn = [int(c) for c in re.sub(r"\D", "", re.match(r"call (.+?)\. ", new[10].text)[1])][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(luhn)) % 10 == 0
    assert new[50].n == 2 and "abcdefghij" not in new[50].text and new[51].text == rows[-1][1]


def test_every_entity_is_hinted(spark):
    entities = (["a@b.io", "1.2.3.4", "+1 20 3000 40", "(555) 010-1234", "555-010-1234", "123-45-6789", "4111 1111 1111 1111",
                 "abcdefab" * 4, "A1B2C3D4" * 4, "AKIA" + "Z" * 16, "sk-" + "x" * 20, "Token :\t'abcdefghijkl", "apikey=abcdefghijkl"]
                + [f"gh{c}_" + "q" * 20 for c in "pousr"] + [f"{t}{dot} Ünal" for t in pii.MALE + pii.FEMALE + pii.OPEN for dot in ("", ".")])
    texts = [before + e for e in entities for before in ("", "so ", "so\n", "(")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", pii.hinted(F.col("text")).alias("may"), F.size(F.regexp_extract_all("text", F.lit(pii.PATTERN), 0)).alias("n")).collect()
    assert len(rows) == len(texts) and [r.text for r in rows if not r.n or not r.may] == []
    plain = spark.createDataFrame([(None,), ("",), ("AMr Bo",), ("Mr bo 7 a-b x_y: z",)], "text string")
    assert not any(r.may for r in plain.select(pii.hinted(F.col("text")).alias("may")).collect())


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda k, e, a, s: F.when(a == 0, F.lit("1.1.1.1")).otherwise(real(k, e, a, s)))
    df = spark.createDataFrame([(1, "2.2.2.2 and 3.3.3.3 and 4.4.4.4")], "doc_id long, text string")
    new = pii.replace_entities(df).first().text.split(" and ")
    assert len(set(new)) == 3 and not set(new) & {"2.2.2.2", "3.3.3.3", "4.4.4.4"}


def test_corpus_holds_no_old_entities(spark, tiny):
    docs = table(spark, tiny, "documents")
    old, new = (" ".join(r.text for r in df.select("text").collect()) for df in (docs, pii.replace_entities(docs)))
    for pattern in (r"[\w.]+@[\w.]+\w", r"(?<!\d)\d{16}(?!\d)", r"\d+\.\d+\.\d+\.\d+", r"\+1 \(\d+\) [\d-]+"):
        before, after = set(re.findall(pattern, old)), set(re.findall(pattern, new))
        assert before and not before & after and len(before) == len(after)


def test_mix_edges(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 8 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id for r in rows if r["size"] == 0} == {2, 3, 5}
    assert sum(r.target for r in {r.s: r for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_short_sources_are_filled_beside_huge_ones(spark):
    sizes = {"a": 300, "b": 9_000, "c": 1_200, "d": 500, "e": 4_500, "x": 1_500_000_000, "y": 3_000_000_000}
    rows = spark.createDataFrame([(i, s, "=" + s, n, s) for i, (s, n) in enumerate(sizes.items())],
                                 "doc_id long, source string, s string, size long, h string")
    for r in mixing.taken(rows).collect():
        assert abs(r.taken - r.target) <= 8 and r.taken <= 3 * r["size"], r


def test_short_sources_are_filled_in_texts(spark):
    few = [("a", 20), ("b", 31), ("c", 100), ("d", 7)]
    docs = spark.createDataFrame([(s, n) for s, n in few] + [("x", 200_000)] * 20 + [("y", 200_000)] * 60, "source string, n int").select(
        F.monotonically_increasing_id().alias("doc_id"), "source", F.expr("repeat('w ', n)").alias("text"))
    rows = mixing.mix(docs).where("size < 200000").collect()
    assert len(rows) == 4 and all(abs(r.taken - r.target) <= 4 for r in rows), rows


def test_drawn_slots_equal_a_count(spark):
    sizes = spark.createDataFrame([("=a", 1, 70_000, 70_000.0), ("=b", 2, 3, 9.0), ("=c", 3, 0, 0.0), ("=d", 4, 900_000, 800_000.4), ("=e", 5, 40, 40.0)],
                                  "s string, place int, source_size long, target double")
    of = mixing.needs(sizes, 8)
    spans = of.collect()
    total = sum(r.slots for r in spans)
    assert [r.slots for r in spans] == [8_750, 3, 0, 100_000, 5] and spans[-1].high == mixing.LATTICE
    points = np.arange(total) * mixing.STEP % mixing.LATTICE
    got = {r.s: r["count"] for r in mixing.drawn(of).groupBy("s").count().collect()}
    assert sum(got.values()) == total
    assert got == {r.s: n for r in spans if (n := int(((points >= r.low) & (points < r.high)).sum()))}
    slots = mixing.schedule(of, 8).toPandas()
    for r in spans:  # all ranks once, words to the target
        own = slots[slots.s == r.s].sort_values("rank")
        assert own["rank"].tolist() == list(range(r.slots)) and own.words.sum() == r.words
        assert (own[own.extra == 0].slot.diff().dropna() > 0).all() and (own[own.extra > 0].slot < total).all()
    assert (slots.extra > 0).sum() <= 20


@pytest.mark.parametrize("block", [1, 7, 512])
def test_ordered_mix_equals_brute_force(spark, docs, block):
    more = docs.selectExpr("*").unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    more = more.unionByName(more.withColumn("source", F.lit("zz"))).where("length(text) < 1000 or text is null")
    sized = mixing.sizes(more)
    got = [r.asDict() for r in mixing.segments(sized, block=block).orderBy("slot", "extra", "s", "first").collect()]
    goal = {r.s: r for r in mixing.needs(mixing.targets(sized), block).collect()}
    stream = {}
    for r in sorted(sized.where("size > 0").collect(), key=lambda r: (r.h, r.doc_id is not None, r.doc_id, r["size"])):
        stream.setdefault(r.s, []).extend((r.doc_id, w) for w in range(r["size"]))
    for s, r in goal.items():
        words = [(g["doc_id"], g["begin"] + w) for g in got if g["s"] == s for w in range(g["words"])]
        assert len(words) == r.words
        passes = [stream[s][i % r.source_size] for i in range(r.words)] if r.words else []
        assert sorted(map(str, words)) == sorted(map(str, passes))
        assert max((g["words"] for g in got), default=0) <= block
    rows = mixing.taken(sized, block=block).collect()
    assert len(rows) == more.count() and sum(r.taken for r in rows) == sum(g["words"] for g in got)


def test_rows_without_id_spread_over_ranges(spark):
    rows = spark.range(40_000).selectExpr("cast(null as long) as doc_id", "'a' as source", "'=a' as s", "2L as size", "'h' as h")
    got = mixing.places(rows)
    assert got.agg(F.countDistinct("start"), F.max("start")).first() == (40_000, 79_998)


def test_archive_round_trip_and_odd_archives(spark, tmp_path):
    page = "x" * 1500
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a.b/c", page), (2, "http://a.b/d", page), (3, None, None), (None, "u v\n", page), (4, "http://x", ""),
            (4, "http://x", ""), (5, "http://y/", inner)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("?"))
    got = {r.page_id: r for r in warc.summary(warc.round_trip(df)).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {
        1: ("revisit", 2, 1500), 2: ("response", None, 1500), None: ("revisit", 2, 1500), 3: ("response", None, 0),
        4: ("response", None, 0), 5: ("response", None, len(inner))}
    assert warc.round_trip(df.where("false")).count() == 0
    again = spark.createDataFrame([(1, "u", page), (7, "v", page), (7, "v", page), (7, "w", page), (7, "w", page), (8, "s", "a"), (8, "s", "a"),
                                   (None, None, None), (None, None, None)], df.schema.fieldNames()[:3]).withColumn("again", F.lit(5))
    shown = sorted((tuple(r)[0:1] + tuple(r)[3:] for r in warc.summary(warc.round_trip(again)).collect()), key=str)
    assert shown == sorted([(1, "revisit", 7), (7, "revisit", 7), (7, "revisit", 7), (7, "revisit", 7), (7, "response", None),
                            (8, "response", None), (8, "response", None), (None, "response", None), (None, "response", None)], key=str)
    ids = [r.capture_id for r in warc.round_trip(again).collect()]
    assert len(set(ids)) == 9
    import gzip

    def record(kind, rid, *more, body=b"hello"):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"Content-Length: {len(body)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"

    parts = [record("request", "q1"), record("response", "r1", "WARC-Concurrent-To: <q1>"),
             record("metadata", "m1", "WARC-Concurrent-To: <q1>"), record("response", "r2"), record("metadata", "m9", "WARC-Concurrent-To: <no>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[:3])))
    (tmp_path / "b.warc").write_bytes(b"junk" + b"".join(parts[3:]) + record("response", "r3", body=b"cut off")[:-8])
    read = warc.read_records(spark, str(tmp_path))
    found = {r.capture_id: r for r in warc.transactions(read).collect()}
    assert set(found) == {"<r1>", "<r2>", "<r3>"} and found["<r3>"].response.truncated
    assert found["<r1>"].request.record_id == "<q1>" and found["<r1>"].metadata.record_id == "<m1>"
    assert bytes(found["<r2>"].response.payload) == b"hello" and found["<r2>"].request is None
    assert [r.record_id for r in warc.orphans(read).collect()] == ["<m9>"]


def test_pipeline_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    kept = corpus_pipeline.quality_rules(spark, docs, tiny)
    verdict = quality.judge(docs, quality.train(docs, table(spark, tiny, "labels")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in verdict.where("quality_rules.kept").collect()}
    once = corpus_pipeline.near_duplicates(spark, kept, tiny)
    clean = corpus_pipeline.personal_data(spark, once, tiny)
    assert clean.count() == once.count() and once.columns == clean.columns == docs.columns
    mixed = corpus_pipeline.source_mix(spark, clean, tiny)
    times = {r.doc_id: round(r.taken / r["size"]) for r in mixing.mix(clean).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(times.values())
    last = corpus_pipeline.run(spark, tiny)
    assert last.count() == mixed.count() and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stage_edges(spark, tiny, docs, none, name, stage):
    got = stage(spark, docs, tiny)
    assert stage(spark, none, tiny).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    if name in ("PII", "SentencePiece"):
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in docs.collect())
    if name == "SimHash near-dedup":
        assert len(ids) == len(set(ids)) and {None, 4} <= set(ids)
    if name == "source mix":
        assert not {2, 3, 5} & set(ids)

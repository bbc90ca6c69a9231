"""Each operator against a plain version, on documents with nulls, empty texts, ties, repeated rows and clashing columns."""

import importlib
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline

from linkloom.llm import op3_private, op4_mixing, op5_minhash, op6_language, op7_decontaminate, op8_sharding, queries, stages
from linkloom.llm._docs import spread
from linkloom.llm.licences import NOTICES, PHRASES
from linkloom.llm.lyndon import lyndon_sort
from linkloom.llm.op1_suffix_dedup import suffix_dedup
from linkloom.llm.op2_licences import scan_licences
from linkloom.llm.op3_private import cleared, entities, private_spans, sanitised
from linkloom.llm.op5_minhash import near_duplicates
from linkloom.llm.op6_language import identify, learn
from linkloom.llm.op7_decontaminate import decontaminate, remove_contaminated
from linkloom.llm.op8_sharding import assign, lpt_shards
from linkloom.llm.op9_line_dedup import LineIndex, PerfectHash, line_dedup
from linkloom.llm.op10_hamming_topk import ORACLE, hamming_top_k
from linkloom.llm.oracles import ORACLE_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp int, kept boolean, bucket int, size long"
BENCH = [(1, "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu"), (2, "short Item words"), (3, None), (4, "..."), (1, "alpha beta gamma delta eps zeta eta theta iota kappa nu")]


def corpus():
    draw = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["été", "straße", "😀", "the", "of"]
    text = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    line = "  A Line That Is Long Enough To Count As One, Surely  "
    base, passage = text(120), text(40)
    docs = [(0, None), (1, ""), (2, " \n\n "), (3, "x"), (4, "One two three four"), (5, "one TWO three four"), (7, "x" * 30000), (8, "x" * 30000), (9, "ab " * 9000)]
    docs += [(10 + i, base) for i in range(30)]
    docs += [(50 + i, " ".join(draw.choice(vocab) if draw.random() < 0.01 else w for w in base.split())) for i in range(30)]
    docs += [(100 + i, f"{text(20)} {passage} {text(20)}\n{line if i % 2 else line.upper()}\n{text(15)}") for i in range(20)]
    docs += [(200, BENCH[0][1].upper() + " x"), (201, "a short, item: words b"), (202, "alpha beta gamma delta eps zeta eta theta iota"), (203, text(5) + " " + BENCH[4][1])]
    docs += [(210, "Under the MIT License and under the mit license; Apache License, Version 2.0 cc-by-nc"), (211, NOTICES["bsd"])]
    docs += [(220, "mail a@b.c_d@e.f 10.0.0.255, 4111 1111 1111 1111 +1 (234) 567-8901")]
    docs += [(230, text(30)), (230, text(30)), (230, text(30)), (None, base), (None, text(60))]
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, docs):
    rows = [(d, t, ("en", "fr", None)[i % 3], ("b", "a", None)[i % 3], 1, 7, None, 3, 9) for i, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_lyndon_sort(spark):
    draw = random.Random(2)
    texts = [bytes(draw.choice(a) for _ in range(draw.randint(0, 70))) for a in (b"a", b"ab", b"abc\xff", bytes(range(256))) for _ in range(40)] + [b"mississippi", b"ab" * 300]
    for r in spark.createDataFrame([(t,) for t in texts], "t binary").select("t", lyndon_sort(spark, F.col("t")).alias("sa")).collect():
        assert np.frombuffer(bytes(r["sa"]), np.int32).tolist() == sorted(range(len(r["t"])), key=lambda i: bytes(r["t"])[i:])


def test_suffix_dedup(df, docs):
    same(suffix_dedup(df).collect(), brute.repeats(docs))


def test_licences(df, docs):
    rows = scan_licences(df).collect()
    same([tuple(r)[:6] for r in rows], brute.phrases(docs, PHRASES))
    by = {r["doc_id"]: r for r in rows}
    assert by[211]["labels"] == "bsd" and by[211]["score"] == 1.0 and by[3]["score"] == 0.0


def test_each_place_of_a_notice(spark):
    words = NOTICES["bsd"].split()
    text = f"one {' '.join(words)} two words {' '.join(words[: len(words) * 4 // 5])} three {' '.join(f'x{i}' for i in range(40))} {' '.join(words[:6])}"
    row = scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [(s["first_word"], round(s["share"], 1)) for s in row["spans"] if s["label"] == "bsd"]
    assert spans[0] == (1, 1.0) and len(spans) == 2 and spans[1][1] == 0.8 and row["labels"] == "bsd"


def test_private(spark, df, docs):
    counts = {r["doc_id"]: r for r in private_spans(df).collect() if r["doc_id"] is not None}
    assert [(s["kind"], s["start"]) for s in counts[220]["base"]] == [("email", 5), ("email", 10), ("ip", 17), ("card", 29), ("phone", 49)]
    clean = df.filter("doc_id = 220").select(sanitised(F.col("text"), entities(F.col("text")))).first()[0]
    assert clean == "mail [email][email] [ip], [card] [phone]"
    told = [(i, f"write to Zorblatt at z{i % 2}@q.org about thing{i}") for i in range(8)] + [(100 + i, f"plain words number {i}") for i in range(40)]
    told = [(d, t.replace("Zorblatt", "Quimby") if "z1@" in t else t) for d, t in told]
    spans = {r["doc_id"]: r["spans"] for r in private_spans(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert {told[0][1][s["start"] : s["end"]] for s in spans[0] if s["kind"] == "term"} >= {"Zorblatt"}
    assert not spans[100]


def test_private_against_brute_force(spark, df, docs, monkeypatch):
    draw = random.Random(3)
    odd = "aZ9.@+-() _%é😀4111111111111111 10.0.0.1 +1 (234) 567-8901 x@y.zz \n,:"
    more = docs + [(1000 + i, "".join(draw.choice(odd) for _ in range(draw.randrange(400)))) for i in range(200)]
    more += [(2000, " ".join(f"a{i}@b.cc" for i in range(20000))), (2001, "1 " * 5000 + "10.1.2.3 " * 3000)]
    both = spark.createDataFrame(more, "doc_id long, text string")
    monkeypatch.setattr(op3_private, "table", lambda *_: both)
    rows = op3_private.op3_private(spark, SF).collect()
    same([tuple(r)[:6] for r in rows], brute.private(more))


def test_secrets_are_spans(spark):
    told = [(1, 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" was'), (2, "API_KEY: abcdefgh12345678"), (3, "token = short1"), (4, "password: onlyletterswithoutanydigit"), (5, "a token of thanks"), (6, "x API-Key=AAAA1111BBBB2222=")]
    rows = {r["doc_id"]: r["spans"] for r in private_spans(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert {d: [dict(told)[d][s["start"] : s["end"]] for s in x] for d, x in rows.items()} == {1: ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"], 2: ["abcdefgh12345678"], 3: [], 4: [], 5: [], 6: ["AAAA1111BBBB2222="]}


def test_nothing_of_overlapping_spans_is_left(spark):
    text = "mail x@10.0.0.1.org now"
    got = spark.createDataFrame([(text,)], "text string").select(cleared(F.col("text"), entities(F.col("text"))), sanitised(F.col("text"), entities(F.col("text")))).first()
    assert got[0] == "mail" + " " * 15 + " now" and got[1] == "mail [email] now"


def test_copies_hide_no_term(spark):
    told = [(i, f"write to Zorblatt at z0@q.org about thing{i}") for i in range(4)] + [(100 + i, f"plain words number {i}") for i in range(40)]
    told += [(200 + i, told[0][1]) for i in range(30)]
    spans = {r["doc_id"]: r["spans"] for r in private_spans(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    for d in (0, 3, 200, 229):
        assert "Zorblatt" in {dict(told)[d][s["start"] : s["end"]] for s in spans[d] if s["kind"] == "term"}
    assert not spans[100]


def test_terms_of_whole_documents(spark):
    far = " ".join(f"filler{k}" for k in range(40))
    told = [(i, f"Zorblatt {far} Ed x{i} z0@q.org, z9@r.org {far} b4d9 Zorblatt 李雷") for i in range(4)] + [(100 + i, f"plain {far} words number {i}") for i in range(40)]
    told += [(200, "no address, but zorblatt and zorblatts")]
    rows = {r["doc_id"]: r for r in private_spans(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    marked = {d: [dict(told)[d][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"] for d, r in rows.items()}
    assert marked[0] == marked[3] == ["Zorblatt", "Ed", "b4d9", "Zorblatt", "李雷"] and marked[200] == ["zorblatt"] and not marked[100]
    assert all(r["spans"][: len(r["base"])] == r["base"] for r in rows.values()) and len(rows[0]["base"]) == 2


def test_mixing(df, docs):
    rows = op4_mixing.mix(df).collect()
    again = op4_mixing.mix(df.repartition(5)).collect()
    same(rows, again)
    assert len(rows) == len(docs) and all(r["taken"] <= 3 * r["size"] for r in rows)
    for s, aim in {(r["source_size"], r["target"]) for r in rows}:
        own = [r for r in rows if (r["source_size"], r["target"]) == (s, aim)]
        large = max(r["size"] for r in own)  # one document of most of a source's words can't be made up for
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < (large if 2 * large > s else 30)
    assert op4_mixing.targets([10, 1000, 100]) == pytest.approx([30, 780, 300]) and op4_mixing.targets([0, 0]) == [0, 0]


def test_mixing_lands_each_source_alike(spark):
    draw = random.Random(3)
    rows = [(i, "a", draw.randint(20, 40)) for i in range(op4_mixing.BLOCK + 200)] + [(9000 + i, "a", 3001 + 977 * i) for i in range(6)]
    small = [(20000 + i, "b", n) for i, n in enumerate([9000, 7001, 5003, 4001, 2503, 1201, 801, 403, 201, 101, 51, 23, 11, 7, 3])]
    got = op4_mixing.mix(spark.createDataFrame([(d, "w " * n, s) for d, s, n in rows + small], "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows + small)
    for own in ([r for r in got if r["doc_id"] < 20000], [r for r in got if r["doc_id"] >= 20000]):
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 30


def test_mixing_deals_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(op4_mixing, "BLOCK", 64)
    seen = []
    fly = op4_mixing.flown
    monkeypatch.setattr(op4_mixing, "flown", lambda df, *a: (seen.append(df.groupBy("source", "block").count().agg(F.max("count")).first()[0]), fly(df, *a))[1])
    rows = [(None, f"w{i % 3} " * (5 + i % 7), "a") for i in range(900)] + [(7, "same text", "a")] * 300 + [(10**6 + i, "b " * 50, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op4_mixing.mix(df).collect()
    assert len(got) == len(rows) and max(seen) < 150
    same(got, op4_mixing.mix(df.repartition(7)).collect())
    for s in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == s) - s) < 30


def test_near_duplicates(df, docs):
    """With null ids, which count as the largest, and rows that share an id: each row is a document of its own."""
    known = [(brute.LAST if d is None else d, t) for d, t in docs]
    want = [(None if d == brute.LAST else d, n, None if c == brute.LAST else c) for d, n, c, _ in brute.near(known)]
    same([tuple(r)[:3] for r in near_duplicates(df).collect()], want)
    rows = [d for d in docs if d[0] is not None and d[0] != 230]
    same(near_duplicates(df.filter("doc_id is not null and doc_id <> 230"), 4).collect(), brute.near(rows))


def test_packs_of_a_leader(spark, monkeypatch):
    monkeypatch.setattr(op5_minhash, "PACK", 3)
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join(f"x{i}" if k in (i, 79 - i) else w for k, w in enumerate(base))) for i in range(30)]
    same(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute.near(rows))


def test_words_are_hashed_alike_at_any_place(monkeypatch):
    draw = random.Random(1)
    texts = [bytes(draw.choice(b"ab \t\nAB") for _ in range(draw.randrange(60))) for _ in range(200)] + [b"", b" ", b"x" * 500, b"a b c", b"A B\x0bc", b"x" * 700, b"y " + b"x" * 700]
    whole = [x.tolist() for x in op5_minhash.shingle_sets(texts, 2)]
    assert [x.tolist() for t in texts for x in op5_minhash.shingle_sets([t], 2)] == whole
    words = [t.lower().split() for t in texts]
    assert [len(x) for x in whole] == [len({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}) if w else 0 for w in words]
    monkeypatch.setattr(op5_minhash, "PIECE", 700)
    a, b, *c = op5_minhash.shingle_sets([b"x" * 700, b"y " + b"x" * 700, b"x" * 700], 1)
    assert a.tolist() == c[0].tolist() and set(a.tolist()) < set(b.tolist())


def test_null_and_repeated_ids_lose_no_document(spark):
    draw = random.Random(8)
    text = lambda: " ".join(f"u{draw.randrange(900)}" for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(5, a), (7, b), (None, a + " x"), (None, b + " x"), (None, c), (None, d), (None, d), (None, d + " x"), (9, a + " y"), (9, e), (11, f), (11, f), (3, g), (11, g + " z")]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_duplicates(df, 4)
    assert got.count() == len(rows) and sorted(map(repr, got.filter("kept").select("doc_id").distinct().collect())) == sorted(f"Row(doc_id={i})" for i in (3, 5, 7, 9, 11, None))
    left = sorted(((r["doc_id"] or 0, r["text"]) for r in stages.near_dedup(spark, df, SF).collect()), key=str)
    known = [x for x in left if x[1] not in (d, d + " x")]
    assert known == sorted([(5, a), (7, b), (0, c), (9, e), (11, f), (3, g)], key=str) and len(left) == 7
    mixed = {r["text"] for r in stages.mixing(spark, df.filter("doc_id is null").dropDuplicates(["text"]), SF).collect()}
    assert len(mixed) == 5 and stages.mixing(spark, df.filter("doc_id is null").dropDuplicates(["text"]), SF).count() == 5


def test_chain_of_near_duplicates(spark):
    draw = random.Random(6)
    words = [f"v{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 9):
            w[draw.randrange(150)] = draw.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"z{(i + k) // 1}" for k in range(60))) for i in range(20)]
    same(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), brute.near(rows))


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = learn(d)
    got = identify(d, profiles).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 ... 34"), (3, "x"), (4, "½ ² Ⅷ"), (5, "²")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(odd, profiles).collect()}
    assert {d for d, x in found.items() if x == ("und", 0.0)} == {None, 1, 2, 4, 5}
    assert {r["lang_pred"] for r in identify(odd, {}).collect()} == {"und"}


def plain_language(text, profiles, size):
    """Out-of-place distance by dictionaries."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    count = {}
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if (g := w[i : i + n]) != " ":
                    count[g] = count.get(g, 0) + 1
    code = lambda g: sum((0 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) + ((1 << 63) if len(g) == 2 else 0)
    mine = sorted((-n, code(g)) for g, n in count.items())[:size]
    if not mine:
        return "und", 0.0
    best = min((sum(abs(i - p.index(g)) if g in p else size for i, (_, g) in enumerate(mine)), lang) for lang, p in profiles.items())
    return best[1], 1 - best[0] / (size * len(mine))


def test_language_against_dictionaries(spark, df, docs):
    profiles = learn(spark.read.parquet(f"{SF}/documents.parquet"))
    unsigned = {lang: [g % 2**64 for g in p] for lang, p in profiles.items()}
    texts = [(i, t) for i, (_, t) in enumerate(docs) if t and len(t) < 2000][:60]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(spark.createDataFrame(texts, "doc_id long, text string"), profiles).collect()}
    for i, t in texts:
        lang, score = plain_language(t, unsigned, 400)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score)


def test_counts_of_long_texts_add_up(monkeypatch):
    x = op6_language.letters("The quick brown fox, naïve façade! " * 50)
    whole = op6_language.profile(x)
    for piece in (1, 2, 3, 7, 64, 1750):
        monkeypatch.setattr(op6_language, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(op6_language.profile(x), whole, strict=True))


def test_decontamination(spark, df, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = brute.leaks(docs, BENCH)
    same([tuple(r)[:6] for r in decontaminate(df, bench).collect()], want)
    assert remove_contaminated(df, bench).count() == sum(not r[5] for r in want)
    assert decontaminate(df, bench.limit(0)).filter("contaminated").isEmpty()


def test_decontamination_in_rounds(spark, df, docs, monkeypatch):
    bench = spark.createDataFrame(BENCH + [(9, "the of"), (10, "the of"), (11, "of the of the")], "item_id long, text string")
    whole = {r["doc_id"]: r for r in decontaminate(df, bench).collect()}
    left = remove_contaminated(df, bench).count()
    for name, value in (("BLOCK_BYTES", 40), ("ROUND", 1), ("SHARD_BYTES", 3000)):
        monkeypatch.setattr(op7_decontaminate, name, value)
    rows = decontaminate(df, bench).collect()
    same([tuple(r)[:6] for r in rows], brute.leaks(docs, [tuple(r) for r in bench.collect()]))
    place = lambda r: sorted(map(tuple, r["matches"]))
    assert place(whole[200]) == place({r["doc_id"]: r for r in rows}[200]) != []
    same([tuple(r) for r in decontaminate(df, bench, places=False).collect()], [tuple(r)[:6] for r in rows])
    assert remove_contaminated(df, bench).count() == left < len(docs)


def test_sharding(df, docs):
    rows = lpt_shards(df).collect()
    assert len(rows) == len(docs)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    where = {}
    for d, t in docs:
        where.setdefault(zlib.crc32((t or "").encode()), set())
    for r in rows:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def connected(**tables):
    con = duckdb.connect()
    for name, (rows, types) in tables.items():
        con.sql(f"CREATE TABLE {name} ({types})")
        con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)
    return con


def test_sharding_against_sql(df, docs):
    con = connected(documents=(docs, "doc_id BIGINT, text VARCHAR"))
    want = con.sql(op8_sharding.ORACLE)
    assert want.columns == lpt_shards(df).columns
    same(lpt_shards(df).collect(), want.fetchall())


def test_plan_in_parts(df, monkeypatch):
    whole = lpt_shards(df).collect()
    monkeypatch.setattr(op8_sharding, "HELD", 7)
    monkeypatch.setattr("linkloom.llm._spark.BROADCAST_ROWS", 0)
    same(lpt_shards(df).collect(), whole)


def test_levels_are_the_heap(monkeypatch):
    draw = random.Random(7)
    for _ in range(50):
        histogram = [(s, draw.randint(1, 200)) for s in draw.sample(range(1, 60), 8)]
        monkeypatch.setattr("linkloom.llm.op8_sharding.ONE_BY_ONE", 64)
        by_level = assign(histogram, 5)
        monkeypatch.setattr("linkloom.llm.op8_sharding.ONE_BY_ONE", 10**9)
        assert by_level == assign(histogram, 5)


def test_line_dedup(df, docs):
    rows = line_dedup(df).collect()
    same([tuple(r)[:4] for r in rows], brute.lines(docs))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    assert sorted(PerfectHash(keys)(keys).tolist()) == list(range(len(keys)))
    one = np.ones(len(keys), np.int64)
    index = LineIndex(keys, keys.astype(np.uint32), one * 2, one)
    assert (index.probe(keys, keys.astype(np.uint32))[0] == 2).all() and (index.probe(keys + np.uint64(1), ~keys.astype(np.uint32))[0] == 0).all()


def test_hamming(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), draw.normal(size=64).astype(float).tolist(), 1) for i in range(300)] + [(None, [1.0], 1), (400, None, 2), (401, [], 3), (402, [None, 1.0], 3)]
    rows += [(500 + i, rows[0][1], 1) for i in range(30)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    con = duckdb.connect()
    embeddings = e.toPandas()  # noqa: F841
    con.sql("CREATE TABLE embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings")
    same(hamming_top_k(e).collect(), con.sql(ORACLE).fetchall())


def test_hamming_of_any_length(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(int(i), draw.normal(size=int(draw.choice([100, 130, 7, 64]))).astype(float).tolist()) for i in range(1, 400)] + [(500 + i, [1.0] * 130) for i in range(90)]
    rows += [(920, []), (940, [None, 1.0]), (501, [1.0] * 130), (7, [0.5] * 130), (7, [0.5] * 130)]
    con = connected(embeddings=(rows, "vec_id BIGINT, embedding FLOAT[]"))
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = con.sql(ORACLE).fetchall()
    same(hamming_top_k(e).collect(), want)
    monkeypatch.setattr("linkloom.llm.op10_hamming_topk.STEP", 50)
    monkeypatch.setattr("linkloom.llm.op10_hamming_topk.BLOCK", 60)
    same(hamming_top_k(e).collect(), want)


def test_spread_keeps_all_rows(spark):
    rows = [(i % 7 or None, f"text {i % 5}" if i % 3 else None) for i in range(200)]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    many = spread(one)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))
    assert many.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    assert spread(many) is many
    assert spread(one.limit(0)).count() == 0


def test_empty_tables(spark, df):
    none = df.limit(0)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert not none.count()
    for out in (suffix_dedup(none), scan_licences(none), private_spans(none), op4_mixing.mix(none), near_duplicates(none), identify(none, learn(none)), decontaminate(none, bench), lpt_shards(none), line_dedup(none)):
        assert out.count() == 0
    assert hamming_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_stage_rejects_by_profiles(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    draw = random.Random(9)
    odd = [(10**6 + i, " ".join("".join(draw.choice("qwrtpsdfghjklzxcvbnm") for _ in range(draw.randint(3, 9))) for _ in range(80)), None, "a", 1) for i in range(5)] + [(10**7, "12 34", None, "a", 1), (10**7 + 1, None, None, "a", 1)]
    both = d.unionByName(spark.createDataFrame(odd, d.schema))
    assert sorted(r["doc_id"] for r in stages.language(spark, both, SF).collect()) == sorted(r["doc_id"] for r in d.collect())
    bare = both.withColumn("lang", F.lit(None).cast("string"))
    assert stages.language(spark, bare, SF).count() == d.count() + 5


def with_sql(spark, monkeypatch, name, docs, bench=BENCH):
    """The rows of a query and of its SQL over small tables."""
    module = importlib.import_module(f"linkloom.llm.{queries.MODULES[name]}")
    frames = {"documents": spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "benchmark": spark.createDataFrame(bench, "item_id long, text string")}
    monkeypatch.setattr(module, "table", lambda _, __, of: frames[of])
    con = connected(documents=(docs, "doc_id BIGINT, text VARCHAR"), benchmark=(bench, "item_id BIGINT, text VARCHAR"))
    want = con.sql(ORACLE_SQL[name])
    return queries.QUERIES[name](spark, SF).select(*want.columns).collect(), want.fetchall()


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op10_hamming_topk", "op3_private"}))
def test_queries_against_sql(spark, docs, monkeypatch, name):
    same(*with_sql(spark, monkeypatch, name, docs))


def test_terms_against_sql(spark, docs, monkeypatch):
    told = [(3000 + i, f"write to Zorblatt at z{i % 2}@q.org about thing{i}, token: abcdef0123456789x") for i in range(8)] + [(4000, "Zorblatt alone, zorblatts not"), (4001, "ZORBLATT é Zorblatt"), (4002, "token=abcdef0123456789x and Secret : 'ABCDEFGHIJKLMNOP1'")]
    told = [(d, t.replace("Zorblatt", "Quimby") if "z1@" in t else t) for d, t in told]
    got, want = with_sql(spark, monkeypatch, "op3_private", docs + told + told[:3])
    same(got, want)
    assert any("term:" in r["spans"] for r in got) and any("secret:" in r["spans"] for r in got)


def test_stages(spark, df):
    out = stages.language(spark, df, SF)
    assert out.columns == list(stages.COLUMNS) and out.filter("text is null").isEmpty() and out.filter("lang is null").isEmpty()
    out = stages.near_dedup(spark, out, SF)
    assert out.groupBy("doc_id").count().filter("count > 1").isEmpty()
    out = stages.mixing(spark, stages.decontamination(spark, out, SF), SF)
    assert out.columns == list(stages.COLUMNS)
    assert stages.sharding(spark, out, SF).count() == out.count() > 0


def test_stages_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_chars", F.col("n_chars").cast("long"))
    draw = random.Random(11)
    base = [f"word{draw.randrange(300)}" for _ in range(80)]
    more = [(5000 + i, " ".join(w if draw.random() > 0.01 else "other" for w in base), None, "src1", 1) for i in range(12)]
    d = d.select(*stages.COLUMNS).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    left = stages.near_dedup(spark, d, SF)
    want = {i for i, _, _, kept in brute.near(rows) if kept}
    assert {r["doc_id"] for r in left.collect()} == want and left.count() == len(want)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    clean = stages.decontamination(spark, left, SF)
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in brute.leaks(rows, bench) if not x[5]}
    mixed = stages.mixing(spark, clean, SF).cache()
    names = sorted({r["source"] for r in clean.collect()})
    size = lambda of, s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in of if r["source"] == s)
    before, after = clean.collect(), mixed.collect()
    for s, aim in zip(names, op4_mixing.targets([size(before, s) for s in names]), strict=True):
        assert abs(size(after, s) - aim) < 30
    assert mixed.groupBy("doc_id").count().filter("count > 3").isEmpty()
    got = stages.sharding(spark, mixed, SF).collect()
    same([tuple(r)[:5] for r in got], after)
    con = connected(documents=([(r["doc_id"], r["text"]) for r in after], "doc_id BIGINT, text VARCHAR"))
    same([(r["doc_id"], *tuple(r)[5:]) for r in got], con.sql(op8_sharding.ORACLE).fetchall())


def test_stages_of_empty_and_odd_tables(spark, df):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a tie", None, "s", 5), (2, "a tie", None, "s", 5), (3, "a tie", "xx", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumn("key", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("slot", F.lit(2)).withColumn("score", F.lit(0))
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.limit(0), SF)
        assert none.count() == 0 and none.columns[:5] == list(stages.COLUMNS)
        out = stage(spark, odd, SF)
        assert out.columns[:5] == list(stages.COLUMNS) and out.count() <= 3 * odd.count()

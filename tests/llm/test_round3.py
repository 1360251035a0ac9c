"""Period runs, spelling variants and the text classifier against brute force and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltloom.llm import lines, lm, mixing, periods, quality, toxicity, variants
from voltloom.llm.near import one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
CLASH = "doc_id bigint, text string, lang string, row string, key string, runs string, N string, word string"


def table(spark, texts, keys=None, langs=None):
    rows = [(i if keys is None else keys[i], t, langs[i] if langs else "en", "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def brute_runs(w):
    out, n = [], len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            seg = w[i:j + p]
            if j - i >= max(p, 12 - p) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                out.append((i, p, j - i + p))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def period_texts():
    draw, texts = random.Random(3), [None, "", " \n\t ", "a " * 11, "a " * 12, "é　x " * 7 + "tail", "The the " * 6]
    for _ in range(50):
        n, k = draw.randint(0, 120), draw.choice([1, 2, 3, 40])
        w = [f"w{draw.randint(0, k)}" for _ in range(n)]
        if n > 4 and draw.random() < 0.6:
            a = draw.randrange(n)
            p = draw.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(draw.choice([" ", "\n", "  \t"]).join(w))
    return texts


@pytest.mark.parametrize("tile", [16, 8192])
def test_runs_and_texts_without_repeats(spark, tile):
    texts = period_texts()
    texts += texts[3:12]  # repeated rows
    keys = [None if i % 7 == 0 else i // 2 for i in range(len(texts))]  # and repeated and null keys
    got = Counter((r["key"], tuple((x["start"], x["period"], x["length"]) for x in r["runs"]), r["text"])
                  for r in periods.collapse(table(spark, texts, keys), tile=tile).collect())
    want = Counter()
    for k, t in zip(keys, texts, strict=True):
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        want[k, tuple(runs), collapsed(w, runs)] += 1
    assert got == want


def test_a_long_text_is_tiled_like_a_short_one(spark):
    draw = random.Random(5)
    w = [f"x{draw.randint(0, 400)}" for _ in range(30_000)]
    w[2000:14_000] = [w[2000 + i % 3999] for i in range(12_000)]  # a period above half a tile
    w[20_000:20_500] = ["y"] * 500
    w[25_000:25_040] = ["y", "z"] * 20
    texts = [" ".join(w), "y " * 20_000]
    got = {r["key"]: r for r in periods.collapse(table(spark, texts)).collect()}
    runs = [(2000, 3999, 12_000), (20_000, 1, 500), (25_000, 2, 40)]
    assert [tuple(x) for x in got[0]["runs"]] == runs and got[0]["text"] == collapsed(w, runs)
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 1, 20_000)] and got[1]["text"] == "y"
    digest = {r["key"]: r["text"] for r in periods.collapse(table(spark, texts), digest=True).collect()}
    assert digest[0] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def test_period_query(spark):
    texts = period_texts() * 4
    got = {r["doc_id"]: r for r in periods.digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = brute_runs(w)
        top = min(((-n, s, p) for s, p, n in runs), default=None)
        assert tuple(got[i])[1:6] == ((len(runs), top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (0, None, None, None, None))
        assert got[i]["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, p, n in runs).encode()).hexdigest()
        assert got[i]["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert periods.digests(table(spark, texts[:1]).filter("doc_id < 0")).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(n):
    forms, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [len(close)]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (n[w], out[w][0], forms[w], n[forms[w]] if forms[w] else None, root)
    return out


def test_groups_match_all_pairs(spark):
    draw, n = random.Random(9), {}
    base = ["".join(draw.choice("abcdeéÀ") for _ in range(draw.randint(5, 9))) for _ in range(60)]
    base += ["".join(draw.choice("ab") for _ in range(k)) for k in (31, 32, 33, 34, 40, 200)]
    for w in base:
        for _ in range(6):
            i = draw.randrange(len(w))
            w = draw.choice([w[:i] + w[i + 1:], w[:i] + draw.choice("abxé") + w[i:], w[:i] + draw.choice("abxé") + w[i + 1:]])
            n[w] = draw.choice([3, 3, 6, 12, 50])
    for i in range(12):
        n["chain"[:4] + "abcdefghijklm"[i] * 3] = 3
        n["q" * (5 + i)] = 3 * 2 ** i  # a chain of twelve forms
    words = spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(3)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.groups(words).collect()}
    assert got == brute_groups(n)
    assert variants.groups(words.filter("n < 0")).count() == 0


def test_variant_query(spark):
    texts = [None, "", "Éclair éclair ÉCLAIR eclair; Hello hello HELLO hallo hallo hallo", "hello-hello×hello÷x hellos hellos hellos", "x" * 70 + " " + "x" * 71] * 3
    texts += ["wordone wordtwo wordten " * 3] * 400
    keys = [None if i % 5 == 0 else i // 2 for i in range(len(texts))]
    count = Counter()
    for k, t in zip(keys, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{k}:{w}".encode())
            count[w if k is None or h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    want = brute_groups({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.digests(table(spark, texts, keys)).collect()}
    assert got == want
    assert any(w not in "wordone wordtwo wordten" for w in got if w[0] == "w")


def test_variant_query_matches_its_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.sql(variants.ORACLE).select("word, form, root, n, n_near, form_n").fetchall(), key=str)
    assert sorted(map(tuple, variants.digests(spark.read.parquet(path)).collect()), key=str) == want


def toxic_corpus(n=600):
    draw, texts, labels, langs = random.Random(2), [], [], []
    plain = ["".join(draw.choice("aeionrst") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    bad = {"en": ["vilex", "gruntox", "moroso"], "de": ["pfuiab", "pfuiung", "pfuizu"]}
    for i in range(n):
        lang = "en" if i % 3 else "de"
        w = [draw.choice(plain) for _ in range(draw.randint(1, 80))]
        toxic = i % 6 in (0, 1)
        if toxic:
            for _ in range(2):
                w.insert(draw.randrange(len(w) + 1), draw.choice(bad[lang]).upper() + ",")
        texts.append(" ".join(w))
        labels.append(int(toxic))
        langs.append(lang)
    return texts, labels, langs


def test_classifier_on_held_out_rows(spark):
    texts, labels, langs = toxic_corpus()
    more = [None, "", "  ", texts[0] * 400]
    docs = table(spark, texts + more, langs=langs + [None] * len(more))
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(3, None), (None, 1), (10**6, 1)], "doc_id bigint, toxic int")
    got = {r["key"]: r for r in toxicity.classify(docs, marks).collect()}
    assert len(got) == len(texts) + len(more)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(got[i]["score"] >= 0.5) == labels[i] for i in held]
    flagged = [got[i]["toxic"] == labels[i] for i in held]
    assert np.mean(right) > 0.95 and np.mean(flagged) > 0.95
    assert all(0 <= r["score"] <= 1 and 0 < r["threshold"] <= 1 for r in got.values())
    assert got[len(texts)]["score"] == got[len(texts) + 1]["score"] < 0.5 <= got[len(texts) + 3]["score"]  # null, empty; a long text with bad words
    # the labels of held-out rows, the language and the key change no score
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["key"]: r["score"] for r in toxicity.classify(docs.withColumn("lang", F.lit("xx")), other).collect()}
    assert max(abs(again[i] - r["score"]) for i, r in got.items()) < 1e-6


def test_classifier_without_labels(spark):
    docs = table(spark, ["a b", None], [None, 4])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.classify(docs, none).collect()
    assert {(r["key"], round(r["score"], 6), r["held_out"], r["toxic"]) for r in rows} == {(None, 0.25, False, False), (4, 0.25, zlib.crc32(b"4") % 5 == 0, False)}
    one = spark.createDataFrame([(4, 1), (4, 0)], "doc_id bigint, toxic int")
    assert len(toxicity.digests(docs, one).collect()) == 2
    assert toxicity.classify(docs.filter("doc_id < 0"), one).count() == 0


def test_word_vectors_share_beginnings():
    got = toxicity.words(pa.array(["RÉEUX réeuxment,rée", None]))
    assert [w.decode() for w in got.distinct.to_pylist()] == ["réeux", "réeuxment", "rée"] and got.bounds.tolist() == [0, 3, 3]
    b = toxicity.buckets_of(got.distinct)
    assert b[0, 1] == b[1, 1] != b[2, 1] and b[0, 0] != b[1, 0]


@pytest.mark.parametrize("texts", [["the the the cat"], ["a"], ["a b a b a b c", "the a b"], ["of the cat of the dog " * 30, "", None, "of the cat"]])
def test_language_model_on_more_shards_than_tokens(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got.append({r["doc_id"]: r for r in lm.score(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, t in enumerate(texts):
        few, many = got[0][i], got[1][i]
        assert few["n_tokens"] == many["n_tokens"] == len(WORD.findall(t or "")) + 1
        assert few["base_score"] == pytest.approx(many["base_score"]) and few["n_known"] == many["n_known"]
        assert few["score"] == pytest.approx(many["score"], abs=0.01 * few["n_tokens"]) and np.isfinite(many["score"])


CLASHES = ("_v", "_n", "_rows", "_i", "_t", "_k", "_doc", "_version", "_dropped", "row", "k", "v", "i", "n", "doc", "version", "DOC", "Copies", "times", "alike", "kept")


def test_other_columns_come_through_the_stages(spark):
    texts = [None, "", "x y z", *["One line that repeats itself.\nand " + " ".join(f"w{j}" for j in range(i * 50, i * 50 + 70)) for i in range(4)]]
    texts += texts[2:5]  # copies
    names = [c for i, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[:i]}]
    rows = [(i if i else None, t, "en", f"s{i % 2}", *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names)).repartition(3)
    labels = spark.createDataFrame([(3, 1)], "doc_id bigint, quality int")
    whole = {r["doc_id"]: r for r in docs.collect()}
    for got in (quality.kept_rows(docs, labels), one_of_each(docs), mixing.mixed(docs), lines.dedup_lines(docs).drop("n_lines", "n_dropped")):
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r[c] == whole[r["doc_id"]][c] for r in found for c in names)
    with pytest.raises(ValueError):
        lines.dedup_lines(docs.withColumn("N_LINES", F.lit(1)))


def test_mixed_rows_alike_in_key_and_text_agree_on_reruns(spark):
    rows = [(1, "a b c", "en", "s", str(i)) for i in range(5)] + [(2, "d e", "en", "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n string")
    one, two = (Counter(map(tuple, mixing.mixed(docs.repartition(p)).collect())) for p in (1, 4))
    assert one == two and sum(one.values())

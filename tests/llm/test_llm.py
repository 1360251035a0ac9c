"""The operators on small tables with nulls, empty and blank texts, repeats and ties, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from voltloom.llm import bpe, counts, lines, lm, mixing, near, quality, tokenfiles, vafile, warc
from voltloom.llm.spans import pack, units, unpack, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
LONG = " ".join(f"w{i}" for i in range(4000))
TEXTS = [None, "", "   \n\t ", "One line of text\none line of TEXT \n\nshort", "ONE line of text", "é  à la　\n\nplage  '¡ 日本", LONG, LONG,
         LONG.replace("w5 ", "x5 "), "a b", "A B", "tail \n\n", "$$ ## the the the the the the", "<|endoftext|> don't <|x"]
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (3, None), (18, 1), (None, 0), (21, 0), (21, 1)], "doc_id bigint, quality int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_units_and_words_round_trip():
    column = pa.array(TEXTS)
    for coded, want in ((words(column), [WORD.findall(t or "") for t in TEXTS]), (units(column), [[t] for t in TEXTS])):
        texts = coded.distinct.to_pylist()
        for i, w in enumerate(want):
            got = [texts[c].decode() for c in coded.codes[coded.bounds[i]:coded.bounds[i + 1]]]
            assert got == w or "".join(got) == (w[0] or "")
    a, b = unpack(pack(np.arange(300, dtype=np.uint16), np.empty(0, np.int64)))
    assert a.tolist() == list(range(300)) and len(b) == 0


def test_bpe_is_tiktokens(docs, empty):
    one, got = bpe.encoder(bpe.vocabulary_path()).encode_ordinary, by_id(bpe.digests(bpe.encode(docs)))
    for i, t in enumerate(TEXTS):
        ids = one(t or "")
        r = got[i * 3]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
    assert bpe.digests(bpe.encode(empty)).count() == 0


def test_token_files_round_trip(docs, empty):
    tok, got, start = tokenfiles.tokenizer(tokenfiles.vocabulary_path()), by_id(tokenfiles.digests(docs)), 0
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i * 3])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.digests(empty).count() == 0


def test_variable_bytes():
    ranks, counts = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7, 1 << 31], np.uint32), np.array([5, 0, 2, 1])
    control, data = tokenfiles.vbytes(ranks, counts)
    raw = [np.frombuffer(b"".join(x.to_pylist()), np.uint8) for x in (control, data)]
    assert tokenfiles.vbytes_decoded(*raw, counts).tolist() == ranks.tolist()


def test_line_dedup(docs, empty):
    first, got = {}, by_id(lines.dedup_lines(docs))
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    for i, t in enumerate(TEXTS):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    for i, t in enumerate(TEXTS):
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or first[key(x)] == i]
        r = got[i * 3]
        assert (r["text"], r["n_lines"], r["n_dropped"], r["extra"]) == ("\n".join(kept), len(all_), len(all_) - len(kept), "x")
    assert lines.dedup_lines(empty).count() == 0


def test_near_duplicates(docs, empty):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in TEXTS], list(range(len(TEXTS)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    got = by_id(near.digests(docs))
    for i, s in enumerate(sets):
        assert tuple(got[i * 3])[1:] == (len(s), root[i] * 3, root[i] == i)
    assert near.digests(empty).count() == 0


def test_reached_matches_all_pairs():
    draw = np.random.default_rng(5)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((draw.choice(base, int(draw.integers(40, 60)), replace=False), draw.integers(100, 130, 8).astype(np.uint64)))) for _ in range(60)]
    got = near.reached(sets, 75)
    link = [[100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets]
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        assert {j for j in range(len(sets)) if got[j] == got[i]} == seen


def test_quality_measures_and_verdict(docs, labels, empty):
    got = by_id(quality.digests(docs, labels))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams, mark = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if grams[tuple(w[k:k + 3])] > 1:
                mark |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(mark) > 50 * len(w)
        assert tuple(got[i * 3])[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark), failed)
        assert got[i * 3]["kept"] == (not failed)  # too few labels to certify any cutoff
    assert quality.digests(empty, labels).count() == 0 and quality.kept_rows(docs, labels).columns == docs.columns


def test_cutoffs_hold_their_limit():
    good, bad = [0] * (quality.BINS + 1), [0] * (quality.BINS + 1)
    good[0], good[40], bad[0], bad[60] = 5000, 200, 100, 400
    assert quality.choose(good, bad, 0.01, 0.01) == 60  # 41 would do as well; the most lenient of equals
    assert quality.choose([10] + [0] * quality.BINS, bad, 0.01, 0.01) is None
    assert quality.tail(0, 100, 0.05) == pytest.approx(0.95 ** 100) and quality.tail(100, 100, 0.05) == pytest.approx(1)


def test_mix_meets_targets(docs, empty):
    rows = mixing.digests(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(WORD.findall(TEXTS[r["doc_id"] // 3] or ""))
        taken[source[r["doc_id"]]] += r["taken"]
    goal = {source[r["doc_id"]]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in goal.values()) == pytest.approx(1.5 * sum(s for _, s in goal.values()))
    for s, (target, size) in goal.items():
        assert target <= 2 * size + 1e-6 and taken[s] <= target + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.digests(docs).collect()))
    assert mixing.digests(empty).count() == 0
    n = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs)[0].withColumnRenamed("doc", "doc_id").collect()}
    assert sum(n.values()) == sum(want.values())


def test_knapsack_is_exact_where_it_can_be():
    lengths, counts = np.array([3, 5, 50, 400]), np.array([7, 9, 6, 5])
    sums = {3 * a + 5 * b + 50 * c + 400 * d for a in range(8) for b in range(10) for c in range(7) for d in range(6)}
    for budget in range(0, 2367, 13):
        take = mixing.fill(budget, lengths, counts, 1 << 16)
        assert (take <= counts).all() and max(x for x in sums if x <= budget) == (lengths * take).sum()


def test_language_model(docs, empty):
    got = by_id(lm.score(docs))
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in TEXTS]
    out = [zlib.crc32(str(i * 3).encode()) % 5 == 1 for i in range(len(TEXTS))]
    c = Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    for i, (t, o) in enumerate(zip(tokens, out, strict=True)):
        r = got[i * 3]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (o, len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t))
        assert r["score"] <= 0
    assert got[18]["score"] > got[18]["base_score"]
    assert lm.score(empty).count() == 0


def test_language_model_drops_its_dictionaries(spark):
    for texts, want in ((["a b c a b", "a b d", None], {"docs"}), ([None, ""], {"docs"})):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        before = {t.name for t in spark.catalog.listTables()}
        got = lm.score(docs)
        made, = {t.name for t in spark.catalog.listTables()} - before
        assert {r[0].removeprefix("kind=") for r in spark.sql(f"SHOW PARTITIONS {made}").collect()} == want
        assert len(got.collect()) == len(got.collect()) == len(texts)  # the scores need them no more


def test_knapsack_of_long_documents():
    one = np.ones(3, np.int64)
    assert mixing.fill(150_000, np.array([100_000, 90_000, 60_000]), one, 1 << 14).tolist() == [0, 1, 1]
    draw = np.random.default_rng(8)
    for _ in range(20):
        lengths = np.unique(draw.integers(20_000, 200_000, 6))
        counts = draw.integers(1, 4, len(lengths))
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {x + k * size for x in sums for k in range(n + 1)}
        for budget in draw.integers(1, max(sums), 5).tolist() + [sorted(sums)[len(sums) // 2]]:
            take = mixing.fill(budget, lengths, counts, 1 << 14)
            assert (0 <= take).all() and (take <= counts).all() and max(x for x in sums if x <= budget) == (lengths * take).sum()


def test_lengths_that_occur_once_are_drawn():
    lengths = np.arange(1, 2001)
    a, b = (mixing.fill(700_000, lengths, np.ones(2000, np.int64), 1 << 14, seed) for seed in (17, 18))
    assert (lengths * a).sum() == (lengths * b).sum() == 700_000 and (a != b).any()
    assert a[:1000].sum() > 200 and a[1000:].sum() > 200 and a.max() == 1


def trigram_scores(rows, fold=1, folds=5):
    """The model's score of each text by hand, from the counts of all training text."""
    texts = [("<s>", "<s>", *WORD.findall((t or "").translate(LOWER)), None) for _, t in rows]
    train = [t for (k, _), t in zip(rows, texts, strict=True) if zlib.crc32(str(k).encode()) % folds != fold]
    grams = [Counter(t[i - n + 1:i + 1] for t in train for i in range(2, len(t))) for n in (3, 2)]
    words_ = Counter(w for t in train for w in t[2:])
    total, kinds = Counter(), Counter()
    for g in grams:
        for gram, k in g.items():
            total[gram[:-1]] += k
            kinds[gram[:-1]] += 1
    n, v = sum(words_.values()), len(words_)

    def p(gram):
        if len(gram) == 1:
            return (words_[gram[0]] + .5) / (n + .5 * (v + 1))
        ctx = gram[:-1]
        if not total[ctx]:
            return p(gram[1:])
        return (max(grams[3 - len(gram)][gram] - .75, 0) + .75 * kinds[ctx] * p(gram[1:])) / total[ctx]

    return [sum(math.log10(p(t[i - 2:i + 1])) for i in range(2, len(t))) for t in texts]


def test_language_model_scores_by_hand(spark):
    # common words are split over shards: their bigrams are still those of all training text
    draw = np.random.default_rng(5)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(40))]
    share = np.array([0.3, 0.1, 0.1, *[0.5 / 40] * 40])
    rows = [(i, " ".join(draw.choice(vocabulary, 60, p=share))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    want, parts = trigram_scores(rows), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = by_id(lm.score(docs))
            for (k, _), w in zip(rows, want, strict=True):
                assert -61 * 0.0045 <= got[k]["score"] - w <= 1e-9, n  # codes are rounded down, by two steps at most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_trie_answers_every_trigram():
    draw = np.random.default_rng(2)
    rows = np.unique(np.stack([draw.integers(0, 9, 400), draw.integers(0, 2, 400), draw.integers(0, 30, 400), draw.integers(0, 40, 400)], 1), axis=0)
    b, g, a, c = rows.T
    n = draw.integers(1, 6, len(rows))
    trie = lm.build(b, g, a, c, n)
    seen, rest = lm.ask(trie, b, g, a, c)
    level = lm.values(lm.ANSWERED)
    for i in range(0, len(rows), 7):
        root, ctx = (b == b[i]) & (g == g[i]), (b == b[i]) & (g == g[i]) & (a == a[i])
        d2 = max(n[root & (c == c[i])].sum() - .75, 0) / n[root].sum()
        l2 = .75 * len(set(c[root])) / n[root].sum()
        d3, l3 = max(n[i] - .75, 0) / n[ctx].sum(), .75 * ctx.sum() / n[ctx].sum()
        assert level[seen[i]] == pytest.approx(d3 + l3 * d2, rel=0.12) and level[rest[i]] == pytest.approx(l3 * l2, rel=0.12)
    assert level[lm.ask(trie, np.array([99]), np.array([0]), np.array([1]), np.array([1]))[1][0]] == pytest.approx(1)


@pytest.mark.parametrize("many", [10 ** 5, 10 ** 6, 10 ** 9])
def test_trie_keeps_small_probabilities(many):
    # root 2: context 3 is always followed by 5, context 4 once by 6; root 7 has one long context with a word seen once
    b, a, c, n = np.array([[2, 3, 5, many], [2, 4, 6, 1], [7, 3, 5, many], [7, 3, 6, 1]]).T
    g, level = np.zeros(4, np.int64), lm.values(lm.ANSWERED)
    trie = lm.build(b, g, a, c, n)
    seen, rest = (level[x] for x in lm.ask(trie, np.array([2, 7]), g[:2], np.array([3, 3]), np.array([9, 6])))
    assert seen[0] == 0 and rest[0] == pytest.approx(0.75 / many * 1.5 / (many + 1), rel=0.02)
    total = many + 1
    assert seen[1] == pytest.approx(0.25 / total + 1.5 / total * 0.25 / total, rel=0.02)
    assert rest[1] == pytest.approx((1.5 / total) ** 2, rel=0.02)
    assert np.isfinite(np.log10(seen + rest * 1e-9)).all()


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 80
    rows = [(5, "http://a/ b", big, 1), (2, None, big, 1), (9, "u", big, 1), (1, "u", None, 1), (3, "u", "short", 1), (4, "u", "short", 1), (None, "u", "none", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    got = {r["page_id"]: tuple(r)[1:5] for r in warc.digests(pages).collect()}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        revisit = page in (5, 9)
        assert got[page] == (len(body), sha(body), "revisit" if revisit else "response", 2 if revisit else None)
    assert warc.digests(pages.filter("page_id > 100")).count() == 0


def test_vector_search(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(0, 0.2, (300, 6))
    v[200:] = v[7]  # a large group of equals
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (500, [float("nan")] * 6), (501, [None] * 6), (600, [])]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vafile.top10(t).collect()}
    x = np.floor(v * 1024).astype(int)
    for q in (0, 100, 200):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert len(got) == 30 and vafile.top10(t.filter("vec_id > 1000")).count() == 0


def repeated_ids(draw):
    v = draw.normal(0, 0.2, (160, 6))
    v[40:70] = v[3]  # equal vectors, many under the id of a query
    ids = np.concatenate((np.arange(1, 41), [100] * 15, np.arange(41, 56), np.repeat([100, 200, 300, 7, 8], 18)))
    return ids, v


def test_vector_search_with_repeated_ids(spark):
    ids, v = repeated_ids(np.random.default_rng(6))
    t = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "vec_id bigint, embedding array<double>").coalesce(1)
    x, want = np.floor(v * 1024).astype(int), Counter()
    for q in (100, 200, 300):  # as in the SQL: the pairs of all rows of a query id are ranked together
        best = sorted((-int(x[j] @ x[i]), int(ids[i])) for j in np.flatnonzero(ids == q) for i in range(len(ids)) if ids[i] != q)[:10]
        want.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(best))
    assert want == Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vafile.top10(t).collect())


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(18, 1), (21, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, d, str(tmp_path)).columns == d.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {18, 21, 24} and out


def test_viterbi_counts(docs, empty):
    scores = counts.pieces(counts.vocabulary_path())
    low = min(scores.values()) - counts.BELOW

    def best(w):  # all splits, from the front
        table = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            options = [(table[s][0] + scores[w[s:end]], table[s][1] + 1, -s) for s in range(end) if w[s:end] in scores]
            if w[end - 1] not in scores:
                k = len(w[end - 1].encode())
                options.append((table[end - 1][0] + low * k, table[end - 1][1] + k, -end))
            table.append(max(options, key=lambda x: (x[0], x[2]))[:2])
        return table[-1][1]

    got = by_id(counts.token_counts(docs))
    for i, t in enumerate(TEXTS):
        assert got[i * 3]["n_tokens"] == sum(best(counts.MARK + w) for w in WORD.findall(t or ""))
    assert counts.token_counts(empty).count() == 0


def test_viterbi_counts_white_space(spark, empty):
    path = counts.vocabulary_path()
    found, low = counts.automaton(path), min(counts.pieces(path).values()) - counts.BELOW
    texts = [*TEXTS[:6], *TEXTS[9:], "a\n\n b", "a   b\t\tc ", " a", "\n\n", "if (x) {\r\n    y();\r\n}", "a \u2581 b", "\u2581", "a\u3000\x0b\x0cb"]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(counts.token_counts(t, white=True))
    for i, text in enumerate(texts):  # whole texts, not cut
        assert got[i]["n_tokens"] == (counts.count(counts.MARK + text.replace(" ", counts.MARK), found, low) if text else 0), text
    assert got[texts.index("a\n\n b")]["n_tokens"] == 4 and got[texts.index("\n\n")]["n_tokens"] == 3
    assert counts.token_counts(empty, white=True).count() == 0

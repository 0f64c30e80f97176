"""Operators against plain versions, on texts that are awkward in every way the docstrings name."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemoflow.llm import catalog, decontaminate, language_id, licenses, mixing, neighbours, ngram_join, personal_data, quality, substrings, token_counts
from mnemoflow.llm.batches import WORD_TABLE, lower_words

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, h long, text_length long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["Ein", "two", "Drei,", "vier", "über", "six", "naïve", "ocho", "nine", "ten"]) + str(r.randrange(40)) for _ in range(n))


SHARED = prose(40, 99)
TEXTS = [
    prose(30, 1), prose(30, 1), None, "", " \n\t ", "one", "one two", "One  TWO", prose(4000, 2), prose(4000, 2)[:-1] + "x",
    prose(20, 3) + "\n" + SHARED, SHARED + " " + prose(20, 4), SHARED.replace("two", "zwei", 1), "É À ünï 漢字 кот", "a" * 50_000,
    "\x00\x01 odd\x7fbytes", "The MIT License and GNU  General-Public License; cc-by", prose(15, 5) * 3,
]
ROWS = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), "clash", i, 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[10]]  # rows that repeat


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_words_equal_the_pattern():
    for t in TEXTS:
        assert [w.decode() for w in lower_words((t or "").encode())] == WORD.findall((t or "").translate(LOWER))
    assert len(WORD_TABLE) == 256


def windows_of(words, size):
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, block_bytes):
    items = [(1, SHARED), (2, "One two"), (10, None), (11, "..."), (3, prose(30, 1)[5:90]), (4, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_index(docs, segment_words=100)
    got = rows_of(decontaminate.match(index, bench, block_bytes=block_bytes), "doc_id", "n_words", "n_hit", "items")
    want = []
    for doc_id, text, *_ in ROWS:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, t in items:
            for w in windows_of(WORD.findall((t or "").translate(LOWER)), 10):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        found.add(str(item))
        want.append((doc_id, len(words), len(hit), sorted(found)))
    assert got == sorted(want)


def test_proximity(spark):
    texts = ["b x a c", "a b c", "a z z z b c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near > 0) for r in decontaminate.decontaminate(docs, bench, window=3, slop=1).collect()}
    assert got == {0: (0, True), 1: (3, True), 2: (0, False), 3: (0, False)}


def test_query_and_stage_find_edited_passages(spark, tmp_path):
    """Against all spans: words put in, words moved, too far apart, over the border of two documents."""
    r, item = random.Random(12), prose(14, 70).split()
    texts = [" ".join(item), " ".join(item[:5] + ["extra"] + item[5:10] + ["more"]), " ".join(item[:4] + item[5:8] + [item[4]] + item[8:]), " ".join(item[:5]), " ".join(item[5:]), None, ""]
    for _ in range(40):
        words = list(item)
        for _ in range(r.randrange(5)):
            words.insert(r.randrange(len(words)), r.choice(["extra", r.choice(item)]))
        texts.append(prose(5, r.randrange(99)) + " " + " ".join(words[r.randrange(4) :]))
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "", 0, 0) for i, t in enumerate(texts)], KIND).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    span, want = 10 + decontaminate.SLOP, {}
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = [Counter(w) for w in windows_of(cut(" ".join(item)), 10)]
    for i, t in enumerate(texts):
        words = cut(t)
        want[i] = sum(w <= Counter(words[k : k + span]) for w in windows for k in range(len(words))) > 0
    got = {x.doc_id: x for x in catalog.op1_decontaminate_near(spark, str(tmp_path)).collect()}
    assert {i: x.n_near > 0 for i, x in got.items()} == {i: x.contaminated for i, x in got.items()} == want
    assert want[1] and want[2] and not got[1].n_hit and not got[2].n_hit and len(set(want.values())) == 2
    kept = {x.doc_id for x in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, near in want.items() if not near}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert language_id.predict(empty, language_id.fit(empty, F.lit(True)), ["doc_id"]).count() == 0
    assert token_counts.token_counts(empty, token_counts.vocabulary([]), ["doc_id"]).count() == 0
    assert personal_data.find(empty, personal_data.fit(empty), ["doc_id"]).count() == 0
    assert substrings.deduplicate(empty).count() == 0
    assert mixing.mix(empty).documents.count() == 0
    assert licenses.scan(empty, ["doc_id"]).count() == 0
    assert quality.score(empty, quality.fit(empty, labels), ["doc_id"]).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, vectors).count() == 0


def test_no_benchmark_leaves_all(spark, docs):
    got = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert got.count() == len(ROWS) and got.where("n_hit > 0").count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = language_id.predict(d.where(held), language_id.fit(d, ~held), ["doc_id", "lang"]).where("lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_of_awkward_texts(docs):
    model = language_id.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id", "text"]).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {i for i, t in enumerate(TEXTS) if not any(c.isalpha() for c in t or "")}
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(docs, language_id.fit(docs, F.lit(False)), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_every_labelled_language_is_learned(spark):
    """Languages of one text, of two, of few very long ones, of rows without an id; each has letters of its own."""
    rows, texts = [], {}
    for k in range(60):
        name, own = f"l{k:02d}", " ".join(chr(0x4E00 + 30 * k + j) * 3 for j in range(30))
        texts[name] = own
        rows += [(None if k % 4 == 3 else 100 * k + j, own * (1 if k % 2 else 40), name) for j in range((1, 2, 10, 1)[k % 4])]
    rows += [(9999, "... 123", "none"), (9998, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), train_chars=200)
    assert model.languages == sorted(texts)
    got = language_id.predict(docs.where("lang <> 'none'"), model, ["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_language_sample_is_bounded(spark):
    rows = [(str(k), "x" * 50, "en") for k in range(20_000)] + [(str(k), "y" * 5000, "long") for k in range(300)] + [(str(k), "z", "few") for k in range(3)]
    sample = language_id.sampled(spark.createDataFrame(rows, "k string, text string, lang string"), 50_000)
    got = {r.lang: r for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if("held").alias("held")).collect()}
    assert 50_000 <= got["en"].chars <= 60_000 and got["en"].held > 0
    assert language_id.MIN_TEXTS <= got["long"].n <= 20
    assert got["few"].n == 3 and got["few"].held == 0


def test_kneser_ney_sums_to_one():
    text = "abracadabra alakazam abra kadabra"
    keys, _, _ = language_id.grams([text])
    k, n = np.unique(keys, return_counts=True)
    model = language_id.estimate({"x": (k, n)})
    symbols = sorted({int(x) & 0xFFFF for x in k})
    for context in {int(x) >> 16 for x in k} | {0x610061007A}:
        each = np.array([(context << 16) | s for s in symbols], np.uint64)
        unknown = np.array([(context << 16) | 0x4E00], np.uint64)
        total = np.exp(model.log_probabilities(each)[:, 0]).sum() + np.exp(model.log_probabilities(unknown)[:, 0]).sum()
        assert total == pytest.approx(1.0, abs=1e-4)


def plain_tokens(v, word):
    """All ways to cut a word, without sharing anything: the best sum, then the fewest pieces."""
    from functools import cache

    @cache
    def best(end):
        if not end:
            return 0.0, 0
        ways = []
        for start in range(end):
            if word[start:end] in v.scores:
                s, n = best(start)
                ways.append((s + v.scores[word[start:end]], -n - 1))
        if word[end - 1] not in v.scores:
            s, n = best(end - 1)
            size = len(word[end - 1].encode())
            ways.append((s + size * v.byte, -n - size))
        s, n = max(ways)
        return s, -n

    return best(len(word))


@pytest.mark.parametrize("most_nodes", [10**6, 1])
def test_token_counts(docs, most_nodes):
    v = token_counts.vocabulary([token_counts.MARK, *"aenotwir", "▁tw", "two", "▁two", "Ein", "ei", "in", "ne", "▁n", "ine", "▁One", "0", "1", "10", "ü", "aaaa"])
    got = token_counts.token_counts(docs, v, ["doc_id"], most_nodes=most_nodes)
    for r in got.collect():
        words = (TEXTS[r.doc_id] or "").split()
        if len(words) == 1 and len(words[0]) > 1000:  # too long for the plain version's recursion
            assert (r.n_words, r.n_tokens) == (1, token_counts.count_plain(v, token_counts.MARK + words[0])[0])
            continue
        want = [plain_tokens(v, token_counts.MARK + w) for w in words]
        assert (r.n_words, r.n_tokens) == (len(words), sum(n for _, n in want))
        assert r.log_score == pytest.approx(sum(s for s, _ in want))


def test_trie_computes_shared_prefixes_once():
    v = token_counts.vocabulary([token_counts.MARK, "a", "b"])
    trie = token_counts.PreTokenTrie(v)
    trie.count("ab aba abab ab")
    assert len(trie.sums) == 1 + len("▁abab")


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = digits(m[0])
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


PERSONAL = [
    "a.b@c.d.e@f.g and x@y z@q.com, me@@host.org a@b@d.e", "é@a.b ü name@host..com -%+@a.co", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3", "9" * 5000 + ".1.1.1",
    "4111 1111-1111 1111 x 4111111111111112 49927398716 5500005555555559.", "+1 (344) 555-8704, +49.30.1234567 +1 +123456789012345678 +(1)2", "", "plain", "𝒳 a@b.co 😀 1.2.3.4",
]


def test_base_spans_equal_the_patterns():
    for t in [*PERSONAL, *(t or "" for t in TEXTS)]:
        assert personal_data.base_spans(t) == plain_spans(t)
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice("a1.@+-( 4)%5") for _ in range(r.randrange(40)))
        assert personal_data.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000 + " @x", "@" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "+1((((" * 30_000, "a@a-" * 50_000):
        personal_data.base_spans(t)


def test_weak_supervision_adds_secrets_and_keeps_base(spark):
    texts = [*PERSONAL, None] + [f"call me at +1 (344) 555-{k:04d} or a{k}@mail.com; password=ab{k:03d}f0e9d8c7b6 then: nothing" for k in range(60)] + ["ratio: identical == wordsonly"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = personal_data.fit(docs)
    assert model.probability("secret|++++0|4|1") > 0.5 > model.probability("secret|-+-00|4|0")
    for r in personal_data.find(docs, model, ["doc_id", "text"]).collect():
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == plain_spans(r.text or "") == [(s.kind, s.start, s.end) for s in r.spans if s.kind in personal_data.BASE_KINDS]
        if r.text and "password" in r.text:
            assert "secret" in {s.kind for s in r.spans} and "[SECRET]" in r.masked and "ab0" not in r.masked
        if r.text is None or not r.spans:
            assert r.masked == r.text


def plain_dedup(rows, size=13, seen=()):
    least = defaultdict(lambda: 1 << 62)
    for doc_id, text, *_ in rows:
        for w in windows_of_exact(BLANKS.findall(text or ""), size):
            least[w] = min(least[w], 1 << 61 if doc_id is None else doc_id)
    for text in seen:
        for w in windows_of_exact(BLANKS.findall(text or ""), size):
            least[w] = -1
    out = []
    for doc_id, text, *_ in rows:
        words = BLANKS.findall(text or "")
        gone = set()
        for i, w in enumerate(windows_of_exact(words, size)):
            if least[w] < (1 << 61 if doc_id is None else doc_id):
                gone.update(range(i, i + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def windows_of_exact(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("size", [13, 3, 7])
def test_substrings(docs, size):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in substrings.deduplicate(docs, size).collect()), key=str) == plain_dedup(ROWS, size)


def test_substrings_that_a_segment_has_many_times(spark):
    r = random.Random(6)
    same = "again and " * 60
    texts = [same, same, prose(30, 1) + " " + same + SHARED, SHARED + " x " + SHARED, SHARED, "again " * 40, SHARED + " x " + SHARED]
    rows = [(i, texts[r.randrange(len(texts))]) for i in r.sample(range(1000), 60)]
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((tuple(x[c] for c in COLUMNS) for x in substrings.deduplicate(docs).collect()), key=str) == plain_dedup(rows)


def test_substrings_of_null_ids(spark):
    rows = [(None, SHARED), (None, SHARED), (7, SHARED + " end"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in substrings.deduplicate(docs).collect()), key=str) == plain_dedup(rows)


def test_batches_equal_history_and_compaction_keeps_the_index(spark, docs):
    index, whole = substrings.new_index(docs), docs
    for k in range(7):
        batch = docs.where((F.col("doc_id") >= 3 * k) & (F.col("doc_id") < 3 * k + 3))
        history = docs.where(F.col("doc_id") < 3 * k)
        got, index = substrings.ingest(batch, index, history if index.runs else None)
        seen = [r[1] for r in ROWS if r[0] < 3 * k]
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain_dedup([r for r in ROWS if 3 * k <= r[0] < 3 * k + 3], seen=seen)
        before = sum(n for _, n in index.runs)
        index = substrings.compact(spark, index, most=2)
        assert len(index.runs) <= 2 and sum(n for _, n in index.runs) == before
    with pytest.raises(ValueError, match="historical"):
        substrings.ingest(whole, index)


def test_shares_fill_like_water():
    assert mixing.shares([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.shares([1, 100, 100], [10, 1, 1]) == [3, 99, 99]
    assert mixing.shares([], []) == [] and mixing.shares([0, 5], [1, 1]) == [0, 5]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mixing(docs, block):
    m = mixing.mix(docs, block=block)
    got = m.documents.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in ROWS)
    taken, targets = Counter(), {}
    for r in got:
        assert r["size"] == len(BLANKS.findall(TEXTS[r.doc_id] or "")) and 0 <= r.taken <= 3 * r["size"]
        key = (r.source_size, r.target)
        taken[key] += r.taken
        targets[key] = r.target
    assert all(abs(taken[k] - t) <= 0.5 + 1e-9 for k, t in targets.items())
    pieces = Counter()
    for p in m.pieces.collect():
        pieces[p.doc_id] += p["last"] - p["first"]
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +pieces == +want
    again = mixing.mix(docs.repartition(5), block=block).documents
    assert rows_of(again, "doc_id", "taken") == rows_of(m.documents, "doc_id", "taken")


def test_licenses_find_every_block(spark):
    notices = [" ".join(t.split()) for t, _ in licenses.TEMPLATES]
    r = random.Random(3)
    texts = []
    for n in notices:
        words = n.split()
        for drop in range(len(words)):
            kept = r.sample(words, len(words) - drop)
            texts.append("first line\n" + " ".join(kept) + " " + prose(r.randrange(30), drop) + "\nlast")
    texts += [None, "", "MIT license", "apache\nlicense", "license " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = set()
        for b, line in enumerate((t or "").translate(LOWER).split("\n")):
            own = set(WORD.findall(line))
            for notice, label in licenses.TEMPLATES:
                full = set(notice.replace(".", " ").split())
                if len(own & full) * 10 >= 8 * len(full):
                    want.add((b, label, round(len(own & full) / len(full), 9)))
        assert {(m.block, m.label, round(m.containment, 9)) for m in got[i].matches} == want
        words = WORD.findall((t or "").translate(LOWER))
        places = sorted((k, label) for p, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert sorted((x.start, x.label) for x in got[i].places) == places


HARD_WRAPPED = [
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
    (" * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as", "gpl"),
    ("All\nrights\n\nreserved", "all-rights-reserved"),
]


def test_licenses_find_notices_across_line_ends(spark):
    r = random.Random(9)
    texts = [f"{prose(20, k)}\n{t}\n{prose(20, 50 + k)}" for k, (t, _) in enumerate(HARD_WRAPPED)] + [None, "", "rights\nreserved", "all " * 30 + "rights reserved"]
    for notice, _ in licenses.TEMPLATES:
        for _ in range(6):
            own = notice.replace(".", " ").split()
            for k in r.sample(range(len(own)), r.randrange(len(own) // 4 + 1)):
                own[k] = "other"
            texts.append(prose(8, r.randrange(99)) + "\n" + "".join(w + r.choice(" \n") for w in own) + notice.split()[-1] + "\n" + prose(8, r.randrange(99)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(docs, ["doc_id"]).collect()}
    for i, (_, label) in enumerate(HARD_WRAPPED):
        assert label in {m.label for m in got[i].runs}
        assert label == "gpl" or label not in {m.label for m in got[i].matches}  # a line of the GPL's holds a shorter template
    for i, t in enumerate(texts):
        words, want = WORD.findall((t or "").translate(LOWER)), set()
        for notice, label in licenses.TEMPLATES:
            own = notice.replace(".", " ").split()
            for k in range(len(words)):
                held = len(set(words[k : k + len(own)]) & set(own))
                if words[k] in own and held * 10 >= 8 * len(set(own)):
                    want.add((k, label, round(held / len(set(own)), 9)))
        assert sorted((m.start, m.label, round(m.containment, 9)) for m in got[i].runs) == sorted(want)


def test_license_query_labels_hard_wrapped_notices(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HARD_WRAPPED)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.op7_licenses(spark, str(tmp_path)).collect()}
    for i, (_, label) in enumerate(HARD_WRAPPED):
        assert label in got[i].labels.split(",") and got[i].score >= 0.8


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    voters = quality.fit(d, labels.where(~held))
    got = quality.score(d.join(labels.where(held), "doc_id"), voters, ["doc_id", "quality"]).collect()
    good = [r.score >= 0.3 for r in got if r.quality == 1]
    junk = [r.score < 0.3 for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) > 0.85


def test_quality_of_awkward_texts(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(12)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    got = quality.score(docs, quality.fit(docs, labels), ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    none = quality.score(docs, quality.fit(docs, labels.where("false")), ["doc_id"])
    assert {r.score for r in none.collect()} == {0.5}


def test_votes_are_exact_and_blocked():
    r = np.random.default_rng(1)
    counts, bins = r.integers(0, 5, (60, quality.TERMS)), r.integers(0, 8, (60, 8))
    v = quality.estimate(counts[:40], bins[:40], r.integers(0, 2, 40).astype(float), rank=8, neighbours=5)
    latent = v.latent(counts, bins).astype(float)
    for i, s in enumerate(v.scores(counts, bins)):
        near = v.vectors.astype(float) @ latent[i]
        top = np.argsort(-near)[:5]
        w = np.maximum(near[top], 0)
        assert s == pytest.approx((w * v.labels[top]).sum() / w.sum(), abs=1e-4)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=6), 2)], "x") for i in range(400)]
    rows += [(400, None, "x"), (401, [0.0] * 6, "x"), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (403, [float("nan")] * 6, "x"), (404, [float("inf")] * 6, "x"), (405, [], "x"), (None, [1.0] * 6, "x"), (406, [1.0, 2.0], "x"), (500, rows[0][1], "x"), (600, rows[0][1], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), rows


def plain_neighbours(rows, k, every=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, v in good:
        if q % every == 0:
            near = sorted((float(neighbours.distances(w[None], v)[0]), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize(("shard_rows", "leaf", "block"), [(10_000, 8, 7), (50, 4, 1000)])
def test_neighbours_are_exact(vectors, shard_rows, leaf, block):
    df, rows = vectors
    index = neighbours.build_index(df, shard_rows=shard_rows, leaf=leaf)
    got = neighbours.search(index, df.where("vec_id % 20 = 0"), 10, block=block)
    assert set(rows_of(got, "query_id", "rank", "vec_id", "score")) == plain_neighbours(rows, 10)


def test_relaxed_bound_keeps_recall(vectors):
    df, rows = vectors
    got = neighbours.search(neighbours.build_index(df, leaf=4), df.where("vec_id % 20 = 0"), 10, relax=1.3)
    want = {(q, i) for q, _, i, _ in plain_neighbours(rows, 10)}
    assert len(want & {(r.query_id, r.vec_id) for r in got.collect()}) / len(want) > 0.9


def plain_components(rows, size, percent):
    sets = {}
    for n, (_, text, *_) in enumerate(rows):
        words = BLANKS.findall((text or "").translate(LOWER))
        sets[n] = frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
                if sets[a] != sets[b]:
                    linked[a].add(sets[b])
                    linked[b].add(sets[a])
    least = defaultdict(lambda: 1 << 62)
    for n, (doc_id, *_) in enumerate(rows):
        least[find(n)] = min(least[find(n)], doc_id)
    return sorted((doc_id, len(sets[n]), least[find(n)], len(linked[n])) for n, (doc_id, *_) in enumerate(rows))


def near_rows():
    r = random.Random(8)
    rows = list(ROWS)
    base = prose(300, 77).split()
    for k in range(60):  # a family whose members lie around the threshold
        words = list(base)
        for _ in range(r.randrange(12)):
            words[r.randrange(300)] = f"w{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(words), "en", "a", 0, "", 0, 0))
    for k in range(15):
        rows.append((2000 + k, prose(100 + k, 78), "en", "a", 0, "", 0, 0))
    return rows


@pytest.mark.parametrize(("size", "percent", "chunk"), [(3, 90, 2048), (5, 80, 2048), (3, 90, 8)])
def test_ngram_join(spark, size, percent, chunk):
    rows = near_rows()
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    got = ngram_join.jaccard_components(docs, size, percent, chunk=chunk)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "n_links") == plain_components(rows, size, percent)


def test_prefix_tree_walk_equals_all_pairs():
    r = random.Random(2)
    base = list(range(60))
    sets = [np.array(sorted(set(base) - set(r.sample(base, r.randrange(9))) | {60 + r.randrange(20)})) for _ in range(50)]
    for percent in (50, 80, 90, 95):
        got = {(i, int(j)) for i, hit in ngram_join.PrefixTree(sets).walk(sets, 80, percent) for j in hit}
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))}
        assert got == want

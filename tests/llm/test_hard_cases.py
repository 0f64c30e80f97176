"""Operators against plain versions where sizes, names, ids or repeats are awkward."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import decontaminate, language_id, licenses, mixing, neighbours, ngram_join, personal_data, quality, scratch, substrings, token_counts
from mnemoflow.llm.batches import kept_names
from tests.llm.test_operators import BLANKS, COLUMNS, SHARED, plain_components, plain_dedup, plain_neighbours, plain_tokens, prose, rows_of


def test_names_that_clash_are_kept_apart(spark):
    """A user's columns named as an operator's own, in any case, or as those it works with."""
    rows = [(1, "the MIT license of mine, a@b.co", "s", "b", "n", "e", "t", 7), (2, None, "s", "b", "n", "e", "t", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE string, base string, n_words string, entropies string, `__text` string, `__0` int")
    keep = docs.columns
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    made = [
        quality.score(docs, quality.fit(docs, labels), keep),
        language_id.predict(docs, language_id.fit(docs.withColumn("lang", F.lit("en")), F.lit(True)), keep),
        token_counts.token_counts(docs, token_counts.vocabulary(["a", "b"]), keep),
        personal_data.find(docs, personal_data.fit(docs), keep),
        licenses.scan(docs, keep),
    ]
    for out in made:
        own = kept_names(keep, [c for c in out.columns[len(keep) :]])
        assert out.columns[: len(keep)] == own
        got = sorted(tuple(r[: len(keep)]) for r in out.collect())
        assert got == rows
    assert "SCORE_kept" in made[0].columns and "n_words_kept" in made[2].columns and "__text" in made[0].columns


def plain_kneser_ney(texts_of, text):
    """Per language, nats per character, from dictionaries of strings."""

    def symbols(t):
        out = ["^"] * 3
        for c in t:
            x = c.lower() if c.isalpha() else " "
            if not (x == " " and out[-1] == " "):
                out.append(x)
        return out

    def discount(counts):
        n = Counter(counts.values())
        return n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    letters = {c for texts in texts_of.values() for t in texts for c in symbols(t)[3:]}
    out = {}
    for name, texts in texts_of.items():
        levels = [Counter(tuple(s[i - 3 : i + 1]) for s in map(symbols, texts) for i in range(3, len(s)))]
        for _ in range(3):
            levels.insert(0, Counter(g[1:] for g in levels[0]))

        def p(g, levels=levels):
            if not g:
                return 1 / (len(letters) + 1)
            counts = levels[len(g) - 1]
            d = discount(counts)
            same = [c for h, c in counts.items() if h[:-1] == g[:-1]]
            if not same:
                return p(g[1:])
            return max(counts[g] - d, 0) / sum(same) * (g in counts) + d * len(same) / sum(same) * p(g[1:])

        s = symbols(text)
        out[name] = -sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / max(1, len(s) - 3)
    return out


def test_language_models_equal_plain_ones():
    texts_of = {"a": ["abra cadabra", "alakazam!", "bar"], "b": ["the  cat sat", "a bat"], "c": ["été brûlé"]}
    counts = {name: np.unique(np.concatenate([language_id.grams([t])[0] for t in texts]), return_counts=True) for name, texts in texts_of.items()}
    model = language_id.estimate(counts)
    asked = ["abracadabra", "the bat, the cat", "tété 12 xyz", "q"]
    got, _ = model.cross_entropies(asked)
    for i, t in enumerate(asked):
        want = plain_kneser_ney(texts_of, t)
        assert got[i] == pytest.approx([want[x] for x in model.languages], rel=1e-4)


def test_language_of_a_long_text_comes_in_pieces():
    r = random.Random(1)
    texts = ["".join(r.choice("ab  c. É漢") for _ in range(r.randrange(400))) for _ in range(20)] + [None, "", " " * 50]
    keys, of, has = language_id.grams(texts)
    for most in (1, 7, 64, 10_000):
        parts = list(language_id.pieces(texts, most))
        assert (np.concatenate([p[0] for p in parts]) == keys).all() and (np.concatenate([p[1] for p in parts]) == of).all()
        assert sorted({int(x) for p in parts for x in p[2]}) == np.flatnonzero(has).tolist()
    model = language_id.estimate({"x": np.unique(keys, return_counts=True)})
    assert all(h.value.nbytes <= 4 * len(h.low) for h in model.seen)


def test_many_languages_store_what_they_have_seen_only():
    counts = {f"l{k:02d}": np.unique(language_id.grams(["".join(chr(0x4E00 + 40 * k + j) for j in range(40))])[0], return_counts=True) for k in range(50)}
    model = language_id.estimate(counts)
    assert len(model.seen[3].value) == sum(len(k) for k, _ in counts.values())


def test_ties_between_languages_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.fit(docs, F.lit(True)), ["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"aa"}


def test_token_counts_equal_plain_ones_with_the_vocabulary_of_the_query(spark, sf):
    v = token_counts.read_vocabulary(token_counts.VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:20] + ["naïve 漢字 \x00 𝒳 a@b.co", "x" * 63 + " " + "y" * 64 + " " + "z" * 65]
    trie = token_counts.PreTokenTrie(v)
    for t in texts:
        want = [plain_tokens(v, token_counts.MARK + w) for w in t.split()]
        n_words, n, total = trie.count(t)
        assert (n_words, n) == (len(want), sum(x for _, x in want))
        assert total == pytest.approx(sum(s for s, _ in want))


def test_one_text_does_not_outgrow_the_trie():
    trie = token_counts.PreTokenTrie(token_counts.vocabulary([token_counts.MARK, *"0123456789"]), most_nodes=1000)
    most, insert = 0, trie.insert

    def watched(word):
        nonlocal most
        out = insert(word)
        most = max(most, len(trie.sums))
        return out

    trie.insert = watched
    n_words, n, _ = trie.count(" ".join(str(k) for k in range(20_000)))
    assert most <= 1000 + token_counts.LONG and n_words == 20_000
    assert n == sum(len(str(k)) + 1 for k in range(20_000))


def test_many_spans_of_one_text_take_little_time():
    t = "call (212) 555-0100 password=ab12cd34ef " * 16_000
    model = personal_data.estimate(Counter(personal_data.pattern(k, t[:400], a, b) for k, a, b in personal_data.more_candidates(t[:400])))
    began = time.perf_counter()
    _, spans = personal_data.all_spans(t, {}, model)
    assert time.perf_counter() - began < 20 and len(spans) >= 16_000


def test_spans_that_overlap_base_spans_are_left_out():
    r, classifier = random.Random(2), personal_data.SpanClassifier({"bias": 9.0})
    for _ in range(500):
        t = "".join(r.choice(["a@b.co", "212-555-0100", "key=", "1.2.3.4", " ", "x9y8z7w6", "+1 212 555 0100", "123-45-6788"]) for _ in range(12))
        base, spans = personal_data.all_spans(t, {}, classifier)
        taken = [(a, b) for _, a, b in base]
        want = []
        for kind, a, b in personal_data.more_candidates(t):
            if all(b <= x or y <= a for x, y in taken):
                want.append((kind, a, b))
                taken.append((a, b))
        assert spans[len(base) :] == sorted(want, key=lambda s: (personal_data.KINDS.index(s[0]), s[1]))


def test_the_gazetteer_votes_on_every_added_kind():
    for kind, yes, no in [("local_phone", "(212) 555-0100", "(011) 555-0100"), ("national_id", "123-45-6788", "078-05-1120"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044"), ("secret", "ab12cd34", "ab12cd34")]:
        before = ["password"] if kind == "secret" else []
        assert personal_data._gazetteer(kind, yes, before) == 1 and personal_data._gazetteer(kind, no, []) == -1
    assert personal_data._gazetteer("name", "Maria Unheard", []) == 1 and personal_data._gazetteer("name", "Unheard", []) == 0


def test_expectation_maximisation_equals_a_plain_one():
    """One vote table for each labeler, over single candidates instead of counts of patterns."""
    r = random.Random(3)
    counts = Counter(f"{r.choice(['secret', 'name'])}|{''.join(r.choice('-0++') for _ in personal_data.LABELERS)}|4|1" for _ in range(200))
    rows = [p.split("|") for p, n in sorted(counts.items()) for _ in range(n)]
    q = [1 / (1 + math.exp(-1.2 * sum("-0+".index(c) - 1 for c in v))) for _, v, *_ in rows]
    for _ in range(50):
        table = {}
        for j in range(len(personal_data.LABELERS)):
            for y in (0, 1):
                mass = [0.5 + sum((x if y else 1 - x) for x, (_, v, *_) in zip(q, rows, strict=True) if v[j] == c) for c in "-0+"]
                table[y, j] = [m / sum(mass) for m in mass]
            if table[1, j][2] < table[0, j][2]:
                table[0, j] = table[1, j] = [(a + b) / 2 for a, b in zip(table[0, j], table[1, j], strict=True)]
        prior = {k: (1 + sum(x for x, row in zip(q, rows, strict=True) if row[0] == k)) / (2 + sum(row[0] == k for row in rows)) for k in ("secret", "name")}
        z = [math.log(prior[k] / (1 - prior[k])) + sum(math.log(table[1, j]["-0+".index(c)] / table[0, j]["-0+".index(c)]) for j, c in enumerate(v)) for k, v, *_ in rows]
        q = [1 / (1 + math.exp(-max(-30, min(30, x)))) for x in z]
    got = personal_data.estimate(counts).reliability
    for j, name in enumerate(personal_data.LABELERS):
        assert got[name]["personal"] == pytest.approx(table[1, j], abs=1e-6) and got[name]["other"] == pytest.approx(table[0, j], abs=1e-6)


def plain_terms(t):
    """Counts of class pairs and of words, and the bins of the shapes, one text at a time."""
    raw = (t or "").encode()
    counts = Counter()
    for a, b in zip(raw, raw[1:], strict=False):
        counts[int(quality._CLASS[a]) * quality._CLASSES + int(quality._CLASS[b])] += 1
    words = BLANKS.findall(t or "")
    many, size = max(len(words), 1), max(len(raw), 1)
    kinds = Counter(int(quality._CLASS[b]) for b in raw)
    letters = max(sum(kinds[k] for k in range(27)) + kinds[54] // 2, 1)
    marks = [kinds[30 + k] for k in range(len(quality._MARKS))]
    trigrams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shares = [again / many, 1 - len(set(trigrams)) / len(trigrams) if trigrams else 0.0, kinds[26] / letters, kinds[27] / size, sum(marks) / size, max(marks) / many]
    bins = [sum(x >= e for e in quality._SHARE_EDGES) for x in shares]
    bins += [sum((size - kinds[28] - kinds[29]) / many >= e for e in quality._LENGTH_EDGES), sum(len(words) / (kinds[29] + 1) >= e for e in quality._LINE_EDGES)]
    return counts, len(words), bins


def test_quality_features_equal_plain_ones(monkeypatch):
    r = random.Random(4)
    texts = [None, "", "one", prose(60, 1), "A, b; C.\n\n42% " * 30, "same " * 200, "".join(r.choice("aZ9 .,\né") for _ in range(700))]
    for counted in (1 << 20, 50):
        monkeypatch.setattr(quality, "_COUNTED", counted)
        got, bins = quality.term_counts(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            counts, n_words, want = plain_terms(t)
            pairs = got[i, : quality._CLASSES**2]
            assert {int(k): int(pairs[k]) for k in np.flatnonzero(pairs)} == dict(counts)
            assert got[i, quality._CLASSES**2 :].sum() == n_words and bins[i].tolist() == want


def test_latent_space_equals_the_exact_decomposition():
    r = np.random.default_rng(6)
    counts = r.poisson(0.05, (80, quality.TERMS)) + (r.random((80, 1)) < 0.5) * r.poisson(0.4, quality.TERMS)
    bins = r.integers(0, 8, (80, 8))
    v = quality.estimate(counts, bins, np.ones(80), rank=6)
    x = quality._features(counts, bins, v.idf).astype(float)
    exact = np.linalg.svd(x, full_matrices=False)[2][:6]
    angles = np.linalg.svd(exact @ v.basis.astype(float))[1]
    assert angles[:3].min() > 0.999 and angles.min() > 0.8


def test_quality_is_learnt_from_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k} of many") for k in range(300)] + [(2, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.fit(docs, labels).labels) == 2


def test_a_long_text_scores_as_it_is_learnt(spark):
    """Counts past what 16 bits hold are the same in both paths."""
    docs = spark.createDataFrame([(1, "aa " * 100_000), (2, "bc de fg " * 40)], "doc_id long, text string")
    voters = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    latent = voters.latent(*quality.term_counts(pa.array([r.text for r in docs.orderBy("doc_id").collect()])))
    assert latent == pytest.approx(voters.vectors, abs=1e-5)


def test_mixed_texts_and_their_stream(spark):
    rows = [(k % 7 if k % 5 else None, prose(r, k), "ab"[k % 2]) for k, r in enumerate([3, 90, 0, 45, 200, 7, 33, 33, 12])] + [(1, "twice the same", "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(docs, block=16)
    got = mixing.texts(mixed, docs).collect()
    assert sorted((r.doc_id, r.text) if r.doc_id is not None else (-1, r.text) for r in got) == sorted((i if i is not None else -1, t) for i, t, _ in rows)
    for r in got:
        assert r["size"] == len(BLANKS.findall(r.text or "")) and sum(p["last"] - p["first"] for p in r.pieces) == r.taken
    flow = mixing.stream(mixing.texts(mixed, docs)).collect()
    by_slot = defaultdict(int)
    for r in flow:
        by_slot[r.slot] += len(r.text.split())
    assert sum(by_slot.values()) == sum(r.taken for r in got) and sum(n < 16 for n in by_slot.values()) <= 2
    again = mixing.texts(mixing.mix(docs.repartition(2), block=16), docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_query_that_repeats_is_asked_once(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(1, 60)]
    rows += [(20, rows[19][1]), (40, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = neighbours.search(neighbours.build_index(df, shard_rows=20, leaf=4), df.where("vec_id % 20 = 0"), 5, block=1)
    lists = Counter((x.query_id, x["rank"]) for x in got.collect())
    assert {lists[20, k] for k in range(1, 6)} == {1} and {lists[40, k] for k in range(1, 6)} == {2}


def test_neighbours_with_ties_and_few_candidates(spark):
    rows = [(i, [float(i % 3), 1.0], "x") for i in range(30)] + [(100, [1.0, 2.0, 3.0], "x"), (200, [0.0, 0.5, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = neighbours.search(neighbours.build_index(df, shard_rows=7, leaf=2), df.where("vec_id % 20 = 0"), 10, block=1)
    assert set(rows_of(got, "query_id", "rank", "vec_id", "score")) == plain_neighbours(rows, 10)


def test_items_without_an_id_and_documents_without_one(spark):
    docs = spark.createDataFrame([(None, SHARED), (None, "x " + SHARED), (4, "other"), (4, SHARED)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, SHARED), (None, "x " + SHARED), (3, "other")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.items, r.n_hit) for r in decontaminate.decontaminate(docs, bench).collect()), key=str)
    n = len(SHARED.split())
    assert [(i, items) for i, items, _ in got] == [(0, [""]), (0, [""]), (4, [""]), (4, ["3"])] and got[0][2] >= n


def test_components_of_rows_without_an_id_or_that_share_one(spark):
    last = 1 << 61
    one, two = prose(60, 31), prose(60, 32)
    rows = [(None, one), (None, one + " end"), (None, two), (3, two + " fin"), (9, one[:200]), (9, two[:150]), (9, prose(50, 33))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = plain_components([(last if i is None else i, t) for i, t in rows], 3, 90)
    none = lambda x: None if x == last else x
    got = ngram_join.jaccard_components(docs, 3, 90)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()))) == sorted(map(str, ((none(a), b, none(c), d) for a, b, c, d in plain)))
    assert got.where("leads").select("set_digest").distinct().count() == len(rows) - 2  # two pairs are linked


@pytest.mark.parametrize(("cuts", "runs"), [((), 4), ((0.2, 0.4, 0.9), 1)])
def test_substring_batches_give_the_same_rows(spark, cuts, runs):
    r = random.Random(10)
    pool = [prose(r.randrange(5, 60), k) for k in range(12)]
    rows = [(r.choice([None, *range(30)]), " ".join(r.choice(pool) for _ in range(r.randrange(4))) or None) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.deduplicate(docs, cuts=cuts, runs=runs)
    assert sorted((tuple(x[c] for c in COLUMNS) for x in got.collect()), key=str) == plain_dedup(rows)


def test_scratch_tables_go_with_their_block(spark):
    df = spark.range(5)
    with scratch.temporary():
        inside = scratch.new_path(spark, "inside")
        scratch.write(df, inside)
        assert spark.read.parquet(inside).count() == 5
    outside = scratch.stored(df, "outside")
    assert outside.count() == 5
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(inside)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def swapped(k, a, b, c, d):
    """A long word that has four letters 64 places apart from ``k`` on."""
    letters = list("x" * (k + 256))
    letters[k], letters[k + 64], letters[k + 128], letters[k + 192] = a, b, c, d
    return "".join(letters)


def test_long_words_that_swap_letters_differ(spark):
    """Words whose letters stand in other places, 65 to 1,000 bytes long, are other words."""
    from mnemoflow.llm.batches import words_of

    seen = {}
    rng = random.Random(7)
    words = [swapped(k, *order) for k in range(0, 64, 9) for order in {tuple(rng.sample("cdcd", 4)) for _ in range(9)}]
    words += ["".join("ab"[bin(i).count("1") % 2 ^ s] for i in range(n)) for n in (64, 65, 128, 256, 1000) for s in (0, 1)]
    words += ["y" * i + "z" + "y" * (999 - i) for i in range(1000)]
    found = words_of(pa.array(words), checked=True)
    for word, key in zip(words, zip(found.hash.tolist(), found.check.tolist(), strict=True), strict=True):
        for part in key:
            assert seen.setdefault(part, word) == word
    shared = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{swapped(3, *'cddc')} {shared}"), (2, f"{swapped(3, *'dccd')} {shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substrings.deduplicate(docs).collect()} == {(1, 0), (2, 0)}
    halves = [(1, " ".join([swapped(3, *"cddc"), *shared.split(), swapped(9, *"cddc")])), (2, " ".join([swapped(3, *"dccd"), *shared.split(), swapped(9, *"dccd")]))]
    joined = ngram_join.jaccard_components(spark.createDataFrame(halves, "doc_id long, text string"), size=3, percent=80)
    assert {(r.doc_id, r.component_id) for r in joined.collect()} == {(1, 1), (2, 2)}


def test_the_largest_id_is_no_null(spark):
    last = (1 << 63) - 1
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(last, text), (None, text), (None, "x y z u"), (None, None), (last, None), (last, "p q r s t"), (5, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(docs).collect())
    assert got == Counter([(last, last, 28), (None, last, 28), (None, None, 2), (None, None, 0), (last, last, 0), (last, last, 3), (5, 5, 3)])
    removed = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicate(docs, cuts=()).collect())
    assert removed == Counter([(last, 30, 0), (None, 30, 30), (None, 4, 0), (None, 0, 0), (last, 0, 0), (last, 5, 0), (5, 5, 0)])

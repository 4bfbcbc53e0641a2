"""Language ID, quality rules, URL filter, mixing and token counts on small and odd tables."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import quality_rules
from tidemark.llm.language_id import _labelled, identify, learn, least_known, predict_languages, presence, with_known_language
from tidemark.llm.mixing import mixed, plan_mix
from tidemark.llm.quality_rules import apply_rules
from tidemark.llm.url_filter import LABELLED_URLS, filter_urls, split_url, train
from tidemark.llm.wordpieces import LongestMatch, token_counts, vocabulary_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = r"[^\x20\x09-\x0D]+"
ODD = [(901, None, None, None), (902, "", "en", "b"), (903, " \n", "en", "b"), (904, "1234 !!", "en", "c"), (905, "same words here", "en", "c"), (905, "same words here", "en", "c"), (None, "no id at all", None, "c")]


@pytest.fixture(scope="module")
def docs(spark, sample_folder):
    return spark.read.parquet(f"{sample_folder}/documents.parquet")


def odd(spark, extra="lang_pred string"):
    return spark.createDataFrame([(*row, "clash") for row in ODD], f"doc_id long, text string, lang string, source string, {extra}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_language_accuracy_on_held_out_rows(spark, docs):
    rows = predict_languages(docs.unionByName(odd(spark), allowMissingColumns=True)).collect()
    found = {r.doc_id: r for r in rows}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth) + len(ODD)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i in truth)
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (901, 902, 903, 904))
    assert all(0 <= r.score <= 1 for r in rows) and found[None].held_out is False


def test_language_filter_keeps_clean_documents(spark, docs):
    kept = with_known_language(docs.unionByName(odd(spark), allowMissingColumns=True).drop("lang_pred"))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and not ids & {901, 902, 903, 904}
    letters = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert len(letters - ids) <= 0.01 * len(letters)


def test_language_filter_refuses_what_was_not_learned(spark, docs):
    letters = np.random.default_rng(3)
    noise = [" ".join("".join(letters.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(200)) for _ in range(10)]
    strange = docs.filter("lang = 'de'").select(F.col("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    gibberish = spark.createDataFrame([(10**9 + k, text, None) for k, text in enumerate(noise)], "doc_id long, text string, lang string")
    clean = docs.filter("lang <> 'de'").select("doc_id", "text", "lang")
    kept = {r.doc_id for r in with_known_language(clean.unionByName(strange).unionByName(gibberish)).select("doc_id").collect()}
    assert not kept & set(range(10**9, 10**9 + 10))
    unlearned, own = ({r.doc_id for r in frame.collect()} for frame in (strange, clean))
    assert len(unlearned & kept) <= 0.2 * len(unlearned) and len(own - kept) <= 0.01 * len(own)


def test_samples_hold_a_repeated_id_once(spark, monkeypatch):
    rows = [(7, f"the same id again {k}", "en") for k in range(60)] + [(k, f"un autre texte {k}", "fr") for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = _labelled(docs, 40).collect()
    assert len(sample) == 31 and [r.text for r in sample if r.doc_id == 7] == ["the same id again 0"]
    labels = spark.createDataFrame([(7, 1), *[(k, 0) for k in range(100, 130)]], "doc_id long, quality int")
    collected, whole = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: collected.append(whole(self)) or collected[-1])
    quality_rules.train(docs.drop("lang"), labels)
    assert [len(frame) for frame in collected] == [31]


def test_language_model_and_threshold_see_every_row(spark):
    """Rows beyond the landmark sample change the regressions and the threshold; partitions and order do not."""
    shape = "doc_id long, text string, lang string"
    few = [(k, f"the cat and dog number {k} of the street", "en") for k in range(40)] + [(k, f"le chat et le chien {k} de la rue", "fr") for k in range(100, 140)]
    more = [(10**6 + k, f"zebra quartz {k} whims jovial", "en") for k in range(400)]
    first = {row.doc_id for row in _labelled(spark.createDataFrame(few + more, shape), 20).collect()}
    rest = [row for row in few + more if row[0] not in first]
    chosen = [row for row in few + more if row[0] in first]
    alone, whole = (learn(spark.createDataFrame(rows, shape), 20, 20) for rows in (chosen, chosen + rest))
    assert (alone.landmarks == whole.landmarks).all() and abs(alone.weights - whole.weights).max() > 1e-3
    again = learn(spark.createDataFrame(list(reversed(chosen + rest)), shape).repartition(7), 20, 20)
    assert (again.weights == whole.weights).all() and (again.offsets == whole.offsets).all()

    held = spark.createDataFrame([(k, f"the cat and dog number {k} of the street", "en") for k in range(3000)] + [(k, "le chat et le chien de la rue", "fr") for k in range(3000, 6000)], shape)
    strange = spark.createDataFrame([(10**6 + k, f"the cat {k} xylophonic jabberwocks", "en") for k in range(2000)], shape)
    got = least_known(held.unionByName(strange), whole)
    judged = held.unionByName(strange).select("lang", identify(F.col("text"), whole, with_known=True).alias("p")).collect()
    shares = {name: [(r.p.known[k], max(r.p.known[1 - k], -1)) for r in judged if r.lang == r.p.lang_pred == name] for k, name in enumerate(whole.languages)}
    most = max(map(len, shares.values()))
    pairs = np.array([pair for own in shares.values() for pair in np.resize(np.array(own), (most, 2))])
    reached, other = np.quantile(pairs[:, 0], 0.01), np.median(pairs[:, 1])
    assert abs(got - min(reached, (reached + other) / 2)) < 1e-3
    assert abs(least_known(held, whole) - got) > 1e-3


def test_language_without_labels(spark):
    rows = predict_languages(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert rows[0].lang_pred == "und"
    assert predict_languages(empty(spark)).count() == 0


def test_presence_reads_whole_texts():
    long = "a" * (1 << 21) + "xyz"
    assert (presence(long) >= presence("axyz")).all()
    assert identify is not None


def brute_counts(text):
    words = re.findall(WORD, text or "")
    lines = [line for line in (text or "").split("\n") if re.search(WORD, line)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_verdicts(spark, docs, sample_folder):
    labels = spark.read.parquet(f"{sample_folder}/labels.parquet")
    more = spark.createDataFrame([(801, "a b c d e f a b c d e f\n\nx\nx\n" * 3), (802, "é ñ " * 9), (803, "#a\n#a\n|<>| 日本")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more).unionByName(odd(spark).select("doc_id", "text"))
    rows = apply_rules(every, labels).collect()
    texts = Counter((r.doc_id, brute_counts(r.text)) for r in every.collect())
    assert texts == Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.probability <= 1
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[r.doc_id], r.kept) for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.95 * len(judged)


def test_quality_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in apply_rules(docs, none).collect())
    assert apply_rules(empty(spark), none).count() == 0


def test_url_rules_and_model(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://EXAMPLE.com?x/en/",
        "https://x.net/es/1", "https://net/fr/", "https://xnet/fr/", "https://İx.net/fr/é", "a://b://c/d", "https://casino-slots.org/", "https://gardening-club.org/roses", "http://example.com",
    ]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in filter_urls(df).collect()}
    assert all((rows[k].host, rows[k].path) == split_url(u or "") for k, u in enumerate(urls))
    got = {k: (rows[k].rule, rows[k].verdict) for k in rows}
    assert got[5] == ("example.com/en/", "block") and got[6] == ("www.example.com/en/", "allow") and got[7] == ("www.example.com/en/", "allow")
    assert got[9] == ("net/es/", "block") and got[10] == ("net/fr/", "block") and got[11][0] is None and got[12] == ("net/fr/", "block")
    assert got[8] == (None, "allow") and got[16] == (None, "allow")
    assert all(got[k] == (None, "allow") for k in (0, 1, 2, 3, 4)) and got[14] == (None, "block") and got[15] == (None, "allow")
    assert filter_urls(df.limit(0)).count() == 0 and len(LABELLED_URLS) < 200 and train().slope > 0


def test_mix_follows_the_targets(spark, docs):
    every = docs.select("doc_id", "text", "lang", "source").unionByName(odd(spark).drop("lang_pred"))
    rows = plan_mix(every).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, open_names = {}, set(names)
    while True:  # raise the level until no source is above its cap
        rest = sum(sizes.values()) - sum(want.values())
        level = rest / sum(weight[s] for s in open_names)
        over = {s for s in open_names if weight[s] * level > 3 * sizes[s]}
        want |= {s: 3 * sizes[s] for s in over}
        open_names -= over
        if not over:
            break
    want |= {s: weight[s] * level for s in open_names}
    assert all(target[s] == pytest.approx(want[s]) for s in names)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, plan_mix(every.repartition(5)).collect()))
    out = mixed(every)
    assert out.columns == every.columns
    assert Counter(r.doc_id for r in out.collect()) == +Counter({i: n for i, n in _copies(rows).items()})
    assert plan_mix(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0


def _copies(rows):
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.copies
    return total


def greedy(word, vocabulary):
    """Pieces by trying the longest first at each place."""
    pieces = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in vocabulary:
                at, pieces = end, pieces + 1
                break
        else:
            return 1
    return pieces


def test_longest_match_equals_greedy_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pieces = [rng.integers(0, 3, rng.integers(1, 6)).tolist() for _ in range(12)]
        machine, known = LongestMatch(pieces), set(map(tuple, pieces))
        for _ in range(60):
            word = rng.integers(0, 3, rng.integers(0, 14)).tolist()
            assert machine.count(word) == greedy(tuple(word), known)


def test_token_counts_of_documents(spark, docs):
    known = set(map(tuple, vocabulary_pieces(PATH)))
    every = docs.limit(40).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text")).unionByName(spark.createDataFrame([(950, "ab" * 20000 + " Ünï\x0bx")], "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts(every, PATH).collect() if r.doc_id != 950)
    want = Counter()
    for r in every.collect():
        words = re.findall(WORD, (r.text or "").lower())
        symbols = [[*w.encode()[:-1], w.encode()[-1] + 256] for w in words]
        if r.doc_id != 950:
            want[r.doc_id, len(words), sum(greedy(tuple(s), known) for s in symbols)] += 1
    assert got == want and json.dumps(len(known))
    assert token_counts(empty(spark), PATH).count() == 0

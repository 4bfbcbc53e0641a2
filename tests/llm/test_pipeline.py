"""The pipeline's stages on the smallest sample, each against what it must keep."""

import re
from collections import Counter

import corpus_pipeline


def test_stages_keep_what_they_must(spark, sample_folder):
    docs = spark.read.parquet(f"{sample_folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "source_mix", "bpe_encoding"]
    known = stages["language_id"](spark, docs, sample_folder)
    assert known.columns == docs.columns
    texts = {r.doc_id: r.text for r in known.collect()}
    unique = stages["exact_dedup"](spark, known, sample_folder)
    kept = {r.doc_id: r.text for r in unique.collect()}
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for doc_id, text in sorted(texts.items(), key=lambda item: (-len(item[1]), item[0])):
        best.setdefault(normal(text), doc_id)
    assert set(kept) == set(best.values()) and unique.columns == docs.columns


#: Names that operators use beside the rows, and ordinary ones, as columns of the documents.
CLASHES = "_id _text _chars _row _rank _language _known _source _copies _copy _rate docs _own _own_id _key _grouped row component_id kept size".split()


def odd_rows():
    long = " ".join(f"w{k}" for k in range(30_000))
    prose = ["the cat and the dog were in the house with the people of the town and it was good for all of them"] * 3
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, long, "en", "b"), (5, long + " more", "en", None),
        *[(10 + k, text, "en", "a") for k, text in enumerate(prose)], (10, prose[0], "en", "a"), (10, prose[0], "en", "a"), (None, "no id here", "en", "b"), (None, "no id here", "en", "b"),
        (20, "½ ² ① 12 !", "en", "c"), (21, "tie", "en", "c"), (22, "tie ", "en", "c"),
    ]


def test_stages_on_odd_rows_with_clashing_names(spark, sample_folder):
    rows = odd_rows()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{name}` string" for name in CLASHES)
    extra = lambda k: tuple(f"{name}-{k}" for name in CLASHES)
    docs = spark.createDataFrame([(*row, *extra(k)) for k, row in enumerate(rows)], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sample_folder)
        assert out.columns == docs.columns
        got = out.collect()
        for row in got:  # every row that stays is one that came, whole
            k = int(row["docs"].split("-")[1])
            assert tuple(row) == (*rows[k], *extra(k)), name
        kept = sorted(int(row["docs"].split("-")[1]) for row in got)
        assert stage(spark, docs.limit(0), sample_folder).columns == docs.columns
        assert stage(spark, docs.limit(0), sample_folder).count() == 0
        if name == "language_id":
            assert not {rows[k][0] for k in kept} & {1, 2, 3, 20}
        elif name == "exact_dedup":
            normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert len(kept) == len({normal(r[1]) for r in rows})
        elif name == "near_dedup":  # rows without words all stay
            assert [rows[k][0] for k in kept if rows[k][0] in (1, 2, 3)] == [1, 2, 3] and sum(rows[k][0] in (4, 5) for k in kept) == 1
            assert sum(rows[k][0] in (10, 11, 12) for k in kept) == 1 and sum(rows[k][0] in (21, 22) for k in kept) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sample_folder)
    assert last.count() == len(rows) and last.filter("doc_id <= 2").agg({"n_tokens": "max"}).first()[0] == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sample_folder).count() == 0


def test_near_and_mix_stages_against_brute_force(spark, sample_folder):
    docs = spark.read.parquet(f"{sample_folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = {}
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c.group().lower(), text))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {doc_id: doc_id for doc_id, _ in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, sample_folder).collect()} == {k for k, r in root.items() if k == r}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {r.doc_id: r.source for r in docs.collect()}
    given, taken, times = Counter(), Counter(), Counter()
    for doc_id, text in texts:
        given[source[doc_id]] += size(text)
    for r in stages["source_mix"](spark, docs, sample_folder).collect():
        taken[r.source] += size(r.text)
        times[r.doc_id] += 1
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(given, key=lambda s: (s is None, s or "")))}
    target, level, open_sources = {}, sum(given.values()), set(given)
    while True:
        share = {s: level * weights[s] / sum(weights[o] for o in open_sources) for s in open_sources}
        full = {s for s in open_sources if share[s] > 3 * given[s]}
        if not full:
            target |= share
            break
        target |= {s: 3 * given[s] for s in full}
        level -= sum(3 * given[s] for s in full)
        open_sources -= full
    assert max(times.values()) <= 3
    longest = max(size(t) for _, t in texts)
    for s, words in given.items():
        # One Bernoulli copy a document: within four deviations of the target.
        spread = (0.25 * sum(size(t) ** 2 for k, t in texts if source[k] == s)) ** 0.5
        assert abs(taken[s] - target[s]) <= 4 * spread + longest

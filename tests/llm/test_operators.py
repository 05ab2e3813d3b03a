"""Each operator against a brute-force version, and over awkward rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from retrova.llm import licence_scan, licences, mcd_rules, merge_dropout, mixing, phrases, quality_bayes, stages, url_filter, url_terms
from retrova.llm import textkit as K
from retrova.llm.line_dedup import repeated_units
from retrova.llm.ngram_join import jaccard_join, jaccard_links, near_groups
from retrova.llm.suffix_dedup import repeated_spans, strip_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, gram string, row string, _cuts string, _hash string, _host string, _quality string, _pattern string, _copies string, tile string, digest string"
WORDS = [f"w{i}" for i in range(60)] + ["été", "naïve", "Ünder", "日本"]


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the rest are columns with names that the operators use themselves."""
    full = [(d, t, la, s, len(t) if t is not None else None, *["mine"] * 11) for d, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward_rows():
    r = random.Random(5)
    base = " ".join(r.choice(WORDS) for _ in range(130))
    other = " ".join(r.choice(WORDS) for _ in range(80))
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, other + " " + base, "fr", None), (None, base, "en", "a"), (4, None, "en", "a"), (5, "", None, None),
        (6, " \n\t ", "de", "b"), (7, "one", "de", "b"), (7, "another text of the same id", "de", "b"), (8, " ".join(r.choice(WORDS) for _ in range(40_000)), "es", "b"), (9, "x " * 300, "en", "c"),
        (10, "same line that has words\nsame line that has words\n\nmore", "en", "c"), (None, None, None, None), (11, base[:-4] + "zz", "en", "c"),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, awkward_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def made(n, seed, words=25, lo=1, hi=60):
    """Random documents of which many share passages."""
    r = random.Random(seed)
    passages = [" ".join(r.choice(WORDS) for _ in range(r.randint(10, 30))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choice(WORDS[:words]) for _ in range(r.randint(lo, hi)))]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        out.append((i, r.choice([" ", "\n", "  "]).join(parts), r.choice(["en", "fr"]), r.choice("ab")))
    for i in range(n, n + n // 4):
        out.append((i, out[r.randrange(n)][1], "en", "a"))
    return out


# suffix-array dedup


def brute_spans(rows, length):
    seen, by = set(), []
    for d, t, *_ in rows:
        if d is not None and t is not None and (d, t) not in seen:
            seen.add((d, t))
            by.append((d, t))
    by.sort()
    first = {}
    covered = defaultdict(set)
    for d, t in by:
        w = t.split(" ")
        w = [x for x in t.replace("\n", " ").split(" ") if x]
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key not in first:
                first[key] = (d, t, i)
            elif first[key][:2] != (d, t) or i >= first[key][2] + length:
                covered[(d, t)].update(range(i, i + length))
    return {(d, t): len(c) for (d, t), c in covered.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_spans_match_brute_force(spark, seed):
    rows = made(60, seed)
    want = defaultdict(int)
    for (d, _), n in brute_spans(rows, 8).items():
        want[d] += n
    got = repeated_spans(docs_of(spark, rows), length=8, k=4).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == dict(want)


def test_suffix_spans_of_frequent_leading_words(spark):
    """So many equal leading words that splitters coincide: the windows are compared across buckets."""
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(i, f"a{i} the the the the the the the the {tail} b{i}", "en", "a") for i in range(80)]
    got = {r["doc_id"]: (r["n_words"], r["first_doc_id"]) for r in repeated_spans(docs_of(spark, rows), length=12, k=4).collect()}
    assert got == {i: (20, 0) for i in range(1, 80)}


def test_suffix_awkward(spark, awkward, empty):
    spans = {(r["doc_id"], r["n_words"]) for r in repeated_spans(awkward, length=50).collect()}
    assert (2, 130) in spans and (3, 130) in spans and (9, 250) in spans and not any(d in (1, 5, 6, 7, None) for d, _ in spans)
    out = strip_spans(awkward, repeated_spans(awkward, length=50))
    assert out.columns == awkward.columns
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert 2 not in ids and 1 in ids and ids.count(None) == 2 and 4 in ids and all(r["_cuts"] == "mine" and r["row"] == "mine" for r in rows)
    kept = next(r for r in rows if r["doc_id"] == 3)
    assert kept["n_chars"] == len(kept["text"]) and kept["text"].split() == awkward_rows()[3][1].split()[:80]
    assert repeated_spans(empty).count() == 0 and strip_spans(empty, repeated_spans(empty)).count() == 0


# n-gram join


def brute_pairs(rows, n, num, den):
    sets = defaultdict(list)
    for d, t, *_ in rows:
        w = (t or "").split()
        if d is not None and w:
            s = frozenset([" ".join(w)]) if len(w) < n else frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
            if d not in sets[s]:
                sets[s].append(d)
    heads = [(min(v), s) for s, v in sets.items()]
    out = {(min(v), d, 1.0) for v in sets.values() for d in v if d != min(v)}
    for i, (a, x) in enumerate(heads):
        for b, y in heads[:i]:
            j = len(x & y) / len(x | y)
            if j * den >= num and a != b:
                out.add((min(a, b), max(a, b), round(j, 6)))
    return out


@pytest.mark.parametrize("seed,threshold", [(1, (1, 2)), (2, (1, 3)), (3, (4, 5)), (4, (1, 1))])
def test_jaccard_pairs_match_brute_force(spark, seed, threshold):
    rows = made(80, seed, lo=1, hi=20)
    got = {(r["doc_a"], r["doc_b"], r["jaccard"]) for r in jaccard_join(docs_of(spark, rows), 3, threshold).collect()}
    assert got == brute_pairs(rows, 3, *threshold) and len(got) > 5


def brute_links(rows, n, num, den):
    """(doc_id, class_id, n_links) over all pairs of documents."""
    docs = []
    for d, t, *_ in rows:
        w = (t or "").split()
        if d is not None and w:
            s = frozenset([" ".join(w)]) if len(w) < n else frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
            if (d, s) not in docs:
                docs.append((d, s))
    label, links = list(range(len(docs))), [0] * len(docs)
    for i, (_, x) in enumerate(docs):
        for j, (_, y) in enumerate(docs[:i]):
            if len(x & y) * den >= num * len(x | y):
                links[i] += 1
                links[j] += 1
                label = [label[j] if v == label[i] else v for v in label]
    least = {v: min(d for (d, _), u in zip(docs, label, strict=True) if u == v) for v in label}
    return sorted((d, least[v], k) for (d, _), v, k in zip(docs, label, links, strict=True) if k)


@pytest.mark.parametrize("seed,threshold", [(1, (1, 2)), (2, (1, 3)), (3, (4, 5)), (4, (1, 1))])
def test_links_and_classes_match_brute_force(spark, seed, threshold):
    rows = made(80, seed, lo=1, hi=20)
    rows += [(i % 40, t, la, s) for i, t, la, s in rows[50:]]  # ids with several texts, and repeated rows
    rows += rows[:5]
    got = sorted(tuple(r) for r in jaccard_links(docs_of(spark, rows), 3, threshold).collect())
    assert got == brute_links(rows, 3, *threshold) and len(got) > 5
    heads = {(r["doc_id"], r["head"]) for r in near_groups(docs_of(spark, rows), 3, threshold).collect()}
    assert heads == {(d, c) for d, c, _ in got if d != c}


def test_hot_columns_are_cut_in_parts(spark):
    """Columns of more sets than `hot` go by pairs of parts, and the links stay the same."""
    r = random.Random(3)
    base = [r.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(40)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w), "en", "a"))
    got = sorted(tuple(x) for x in jaccard_links(docs_of(spark, rows), hot=4).collect())
    assert got == brute_links(rows, 3, 1, 2) and max(k for *_, k in got) > 20


def test_jaccard_awkward(awkward, empty):
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard_join(awkward).collect()}
    assert (1, 2) in got and (1, 11) in got and (1, 3) in got and not any(None in p or p[0] == p[1] for p in got)
    assert jaccard_join(empty).count() == 0 and near_groups(empty).count() == 0 and jaccard_links(empty).count() == 0
    assert sorted(tuple(r) for r in jaccard_links(awkward).collect()) == brute_links(awkward_rows(), 3, 1, 2)


# lines


def brute_units(rows, unit, min_words):
    first, copies, all_, seen = {}, defaultdict(int), defaultdict(list), set()
    cuts = {"line": r"(\n)", "paragraph": r"(\n[ \t\r\v\f]*\n)", "sentence": r"(\n|(?<=[.!?])(?=[ \t\r\v\f]))"}[unit]
    for d, t, *_ in rows:
        if d is None or t is None:
            continue
        at = seq = 0
        for k, part in enumerate(re.split(cuts, t)):
            key = " ".join(part.lower().split())
            if k % 2 == 0 and key:
                copies[key] += 1
                first[key] = min(first.get(key, (d, k // 2)), (d, k // 2))
                if (d, t) not in seen:
                    all_[d, t].append((k // 2, at, key, seq))
                seq += 1
            at += len(part)
        seen.add((d, t))
    out = []
    for (d, _), own in all_.items():
        run, last = [], None
        for no, at, key, seq in [*own, (0, 0, None, -9)]:
            if seq - 1 != last or key is None or first[key] == (d, no):
                if sum(len(x[2].split()) for x in run) >= min_words:
                    out += [(d, n, a, *first[x], copies[x]) for n, a, x in run]
                run = []
            if key is not None and first[key] != (d, no):
                run.append((no, at, key))
                last = seq
    return sorted(out)


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
@pytest.mark.parametrize("min_words", [1, 3, 12])
def test_repeated_units_match_brute_force(spark, unit, min_words):
    r = random.Random(4)
    rows = made(40, 4) + awkward_rows()
    rows = [(d, re.sub(" ", lambda m: r.choice([" ", " ", " ", ". ", "\n", "\n\n", "? ", " \t"]), t) if t and len(t) < 5000 else t, la, s) for d, t, la, s in rows]
    rows += [(100 + i, t, la, s) for i, (d, t, la, s) in enumerate(rows[:30])] + rows[:10]
    got = sorted(tuple(x) for x in repeated_units(docs_of(spark, rows), unit, min_words).select("doc_id", "unit_no", "start", "first_doc_id", "first_unit_no", "copies").collect())
    assert got == brute_units(rows, unit, min_words) and got


def test_line_dedup(spark, awkward, empty):
    assert {r["doc_id"] for r in repeated_units(awkward, "line", 5).collect()} >= {2, 10}
    ranked = docs_of(spark, [(1, "one line\nof them", "en", "a"), (2, "One  line\nOF THEM", "en", "a")]).withColumn("rank", -F.col("doc_id"))
    assert {(r["doc_id"], r["first_doc_id"]) for r in repeated_units(ranked, "line", 4, rank_col="rank").collect()} == {(1, 2)}
    assert repeated_units(empty).count() == 0


def test_short_common_units_stay_and_runs_go(spark):
    """A short sentence that many texts have stays in them; in a repeated passage, or repeated on end in one text, it goes."""
    passage = "It was so. The rain fell on the roofs of the old town all night. Nobody slept. In the morning the streets were rivers and the square a lake."
    rows = [(1, "First words. It was so. Own end of one.", "en", "a"), (2, f"Before it {passage} And after", "en", "a"), (3, f"Other start. {passage} Other end. Nobody slept. Quite.", "en", "a"), (4, "\n".join(["row"] * 40), "en", "a")]
    got = {(r["doc_id"], r["unit_no"]) for r in repeated_units(docs_of(spark, rows), "sentence", 25).collect()}
    assert got == {(3, k) for k in (1, 2, 3, 4)} | {(4, k) for k in range(1, 40)}


def test_paragraph_dedup(spark):
    rows = [(1, "a b c d e\nf\n\nother one is here now", "en", "a"), (2, "start of it\n \nA  b c d E\nf\n\nx", "en", "a")]
    got = repeated_units(docs_of(spark, rows), "paragraph", 5).collect()
    assert [(r["doc_id"], r["unit_no"], r["start"], r["n_chars"]) for r in got] == [(2, 1, 14, 12)]


# SentencePiece


def test_merge_dropout(spark, awkward, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = merge_dropout.default_model()
    texts = {(r["doc_id"], r["text"]) for r in awkward.collect() if r["doc_id"] is not None and r["text"] is not None}
    got = merge_dropout.encode_documents(awkward, dropout=0.2, seed=3).withColumn("back", merge_dropout.decoded(F.col("ids"))).collect()
    assert {(r["doc_id"], r["back"]) for r in got} == texts and all(r["lossless"] for r in got) and len(got) == 12
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = merge_dropout.encode_documents(docs_of_texts(spark), dropout=0).collect()
    for r in plain:
        assert r["ids"] == sp.encode(TEXTS[r["doc_id"]])
    rows = [(i, "internationalisation of the documentation", "en", "a") for i in range(60)]
    kinds = {tuple(r["ids"]) for r in merge_dropout.encode_documents(docs_of(spark, rows), dropout=0.3, seed=1).collect()}
    assert len(kinds) > 10
    assert merge_dropout.encode_documents(empty).count() == 0


def test_merge_dropout_draws_for_each_occurrence():
    """Occurrences of a word are cut as the agenda worked off for each alone, and a single merge is skipped at the rate of dropout."""
    v = merge_dropout.vocabulary(merge_dropout.default_model())
    of = lambda text, n, key=0, **more: merge_dropout.encode(v, np.frombuffer(text.encode() * n, np.uint8), np.arange(n + 1) * len(text), K.mix(np.arange(key, key + n).astype(np.uint64)), **more)
    ids, counts = of("internationalisation", 4000, dropout=0.3, seed=1)
    rows = [tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert len(set(rows)) > 200
    assert all(tuple(of("internationalisation", 1, i, dropout=0.3, seed=1)[0]) == rows[i] for i in range(100))
    # a letter and the space before it have one merge
    one = next(w for w in "abcdefghijklmnopqrstuvwxyz" if of(w, 1, dropout=0)[1][0] == 1)
    _, counts = of(one, 20_000, dropout=0.1, seed=3)
    assert abs((counts == 2).mean() - 0.1) < 0.01


TEXTS = ["The quick brown fox  jumps.\nOver lazy dogs, naïvely: 日本語 😀", "a", "don't   stop", "Über allen Gipfeln ist Ruh'", "x" * 200]


def docs_of_texts(spark):
    return docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])


# fingerprints


def test_fingerprints(spark, awkward, empty):
    rows = awkward.collect()
    got = phrases.fingerprints(awkward, depth=3).collect()
    assert len(got) == sum(r["doc_id"] is not None and r["text"] is not None for r in rows)
    prints = defaultdict(set)
    for r in got:
        prints[r["doc_id"]].add(r["fingerprint"])
    assert prints[1] == prints[2] and prints[1] != prints[11] and prints[5] == {0} and len(prints[7]) == 2
    r = random.Random(1)
    shared = " ".join(r.choice(WORDS) for _ in range(400))
    two = docs_of(spark, [(1, "abc " + shared + " end", "en", "a"), (2, "a quite different start, with 17 other words " + shared, "en", "a")])
    a, b = (r["names"] for r in phrases.fingerprints(two, depth=4).orderBy("doc_id").collect())
    assert len(set(a) & set(b)) > 0.8 * min(len(a), len(b))
    assert phrases.fingerprints(empty).count() == 0


def test_fingerprint_phrases_are_consistent():
    """Phrases partition the text, and equal phrases have equal names."""
    r = random.Random(2)
    text = ("".join(r.choice("ab") for _ in range(3000)) + "aaaaaaaa" * 20).encode()
    p = phrases.parse(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 2)
    cuts = [*p["begin"].tolist(), len(text)]
    named = defaultdict(set)
    for n, a, b in zip(p["names"].tolist(), cuts, cuts[1:], strict=False):
        named[n].add(text[a:b])
    assert cuts[0] == 0 and cuts == sorted(cuts) and all(len(v) == 1 for v in named.values())


# quality


def labelled(spark, n=400):
    r = random.Random(3)
    good, bad = WORDS[:40], [*WORDS[30:60], "!!!", "$$$", "WIN"]
    rows, labels = [], []
    for i in range(n):
        ok = r.random() < 0.7
        site = "bad" if not ok and r.random() < 0.8 else r.choice("abc")
        rows.append((i, " ".join(r.choice(good if ok else bad) for _ in range(r.randint(5, 60))), "en", site))
        labels.append((i, int(ok), 0))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier_on_held_out_rows(spark, awkward, empty):
    docs, labels = labelled(spark)
    train = labels.where("doc_id % 2 = 0")
    model = quality_bayes.train_on(docs, train, F.col("quality") == 1)
    kept = {r["doc_id"] for r in quality_bayes.keep_good(docs, model, 0.5).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum((r["doc_id"] in kept) == bool(r["quality"]) for r in held) / len(held) > 0.95
    out = quality_bayes.keep_good(awkward, model, 0.0)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert len(rows) == 13 and all(r["_host"] == "mine" and r["_quality"] == "mine" for r in rows)
    assert quality_bayes.keep_good(empty, model).count() == 0
    blank = quality_bayes.train_on(empty, labels.limit(0), F.col("quality") == 1)
    assert quality_bayes.classify(awkward, blank).count() == awkward.count()


def test_sparse_sites_shrink(spark):
    rows = [("h", "big", 0.1)] * 500 + [("h", "small", 0.9)] + [("g", "p", 0.9)] * 500 + [("solo", "one", 0.0)]
    got = {(r["host"], r["path"]): r for r in quality_bayes.posterior_rates(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert abs(got["h", "big"]["path_rate"] - 0.1) < 0.02 and got["h", "small"]["path_rate"] < 0.85
    assert got["solo", "one"]["path_rate"] > 0.0 and got["g", "p"]["path_rate"] > 0.8


# outliers


def test_robust_outliers(spark, awkward, empty):
    r = random.Random(8)
    plain = [(i, ". ".join(" ".join(r.choice(WORDS[:60]) for _ in range(12)) for _ in range(r.randint(4, 40))), "en", "a") for i in range(500)]
    odd = [(1000 + i, "$$$ ### 111 " * 60, "en", "a") for i in range(40)]
    d = mcd_rules.robust_distances(docs_of(spark, plain + odd))
    kept = {x["doc_id"] for x in mcd_rules.within(d).collect()}
    assert len(kept & set(range(500))) > 490 and not kept & set(range(1000, 1040))
    rows = mcd_rules.robust_distances(awkward).collect()
    assert len(rows) == 13 and all(x["level"] == 0 and x["distance"] == x["distance"] for x in rows)
    assert mcd_rules.robust_distances(empty).count() == 0


def test_outliers_are_judged_by_the_core_and_not_by_the_floor(spark):
    """A covariance over the floor stays as it is, and texts stuffed with odd marks are beyond the cut."""
    root = np.tril(np.random.default_rng(1).normal(size=(mcd_rules.P, mcd_rules.P))) + 4 * np.eye(mcd_rules.P)
    cov = root @ root.T * np.outer(mcd_rules.FLOOR, mcd_rules.FLOOR)
    white = mcd_rules._whitening(cov)[0]
    assert np.allclose(white @ cov @ white.T, np.eye(mcd_rules.P))
    r = random.Random(12)
    line = lambda: " ".join(r.choice(WORDS[:60]) for _ in range(12))
    plain = [(i, ". ".join(line() for _ in range(r.randint(8, 30))), "en", "a") for i in range(600)]
    stuffed = [(1000 + i, ". ".join(line() + " $#%^@~ $#%^" for _ in range(r.randint(8, 30))), "en", "a") for i in range(30)]
    kept = {x["doc_id"] for x in mcd_rules.within(mcd_rules.robust_distances(docs_of(spark, plain + stuffed))).collect()}
    assert len(kept & set(range(600))) > 590 and not kept & set(range(1000, 1030))


# URLs


def brute_url(url, strict, soft):
    url = (url or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    url = re.sub("%[0-9a-f]{2}", "%", url)
    count = lambda t: len(re.findall(rf"(?=(?<![a-z0-9]){re.escape(t)}(?![a-z0-9]))", url))
    hit = [t for t in soft if count(t)]
    return sum(map(count, strict)), len(hit), sum(soft[t] for t in hit)


def test_url_filter(spark):
    strict, soft = ("casino", "bad-site"), {"buy": 1.0, "free": 1.0, "win": 0.5, "bad": 2.0}
    r = random.Random(6)
    bits = ["casino", "casinos", "bad-site", "bad", "buy", "free", "FREE", "win", "/", "-", ".", "é", "ok", "http://", "_", "%2F", "%20", "%e9"]
    urls = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(500)] + [None, "", "a/" * 50_000 + "casino"]
    pages = spark.createDataFrame([(i % 400 if i % 7 else None, u, "x", "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, rejected string")
    got = url_filter.url_scores(pages, strict, soft, soft_limit=3, weight_limit=3.0).collect()
    assert len(got) == len(urls)
    for row in got:
        s, n, w = brute_url(row["url"], strict, soft)
        assert (row["n_strict"], row["n_soft"], row["weight"], row["rejected"]) == (s, n, w, s > 0 or n >= 3 or w >= 3.0), row["url"]
    assert url_filter.url_scores(pages.limit(0)).count() == 0


def test_url_terms(tmp_path):
    assert len(url_terms.STRICT) > 100 and len(url_terms.SOFT) > 80 and not set(url_terms.STRICT) & set(url_terms.SOFT)
    (tmp_path / "t.tsv").write_text("gambling\tcasino\t\nspam\tfree\t1.5\n")
    assert url_terms.load(str(tmp_path / "t.tsv")) == (("casino",), {"free": 1.5})


# mixing


def test_flow_fills_quotas_at_least_cost():
    flow, lacks = mixing.min_cost_flow({"10": 100.0, "11": 50.0, "01": 10.0}, [100.0, 100.0])
    assert lacks == [0.0, 0.0]
    assert sum(f[0] for f in flow.values()) == pytest.approx(100) and sum(f[1] for f in flow.values()) == pytest.approx(100)
    copies = {p: sum(f) / c for (p, f), c in zip(flow.items(), (100.0, 50.0, 10.0), strict=True)}
    assert copies["01"] == pytest.approx(2, abs=1) and copies["10"] <= 1.0 + 1e-9


def test_flow_cost_against_brute_force():
    """The least cost over all whole flows of a small network."""
    import itertools

    cap, quota = {"10": 2.0, "11": 2.0, "01": 1.0}, [3.0, 4.0]
    flow, lacks = mixing.min_cost_flow(cap, quota, levels=3)
    cost = lambda used: sum(sum(level * min(max(u - level * c, 0), c) for level in range(3)) for u, c in zip(used, cap.values(), strict=True))
    best = min(cost((a, b + c, d)) for a, b, c, d in itertools.product(range(7), range(7), range(7), range(4)) if a + b == 3 and c + d == 4 and b + c <= 6)
    assert sum(lacks) == 0 and cost([sum(f) for f in flow.values()]) == pytest.approx(best)


def test_mixing_hits_weights(spark, awkward, empty):
    r = random.Random(7)
    rows = [(i, " ".join(["w"] * r.randint(5, 40)), "en" if r.random() < 0.8 else "fr", "a") for i in range(3000)]
    sources = {"en": F.col("lang") == "en", "fr": F.col("lang") == "fr"}
    out = mixing.mixed(docs_of(spark, rows), sources, {"en": 0.5, "fr": 0.5}, epochs=1.0, seed=1)
    got = {x["lang"]: x["n"] for x in out.groupBy("lang").agg(F.sum(F.col("_tokens") * F.col("_copies")).alias("n")).collect()}
    assert abs(got["en"] / sum(got.values()) - 0.5) < 0.02
    again = mixing.mixed(docs_of(spark, rows), sources, {"en": 0.5, "fr": 0.5}, epochs=1.0, seed=1)
    assert {(x["doc_id"], x["_copies"]) for x in out.collect()} == {(x["doc_id"], x["_copies"]) for x in again.collect()}
    rows = mixing.mixed(awkward, sources, {"en": 0.5, "fr": 0.5}, seed=1).collect()
    assert {5, 6, 8} <= {x["doc_id"] for x in rows} and all(x["tile"] == "mine" for x in rows)
    assert mixing.mixed(empty, sources, {"en": 1, "fr": 1}).count() == 0


# licences


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    return licence_scan.train([" ".join(r.choice(WORDS) for _ in range(r.randint(3, 40))) for _ in range(300)])


def test_licences_on_unseen_notices(spark, model, empty):
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    seen = [("mit", "Released under the MIT License."), ("apache", "Licensed under the Apache License, Version 2.0."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("mit", "This module is released under the MIT license, see LICENSE"), ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    rows = [(i, f"{prose(20)}\n{prose(10)} {t}\n{prose(30)}", "en", "a") for i, (_, t) in enumerate(seen)]
    rows += [(100 + i, f"{prose(15)}\n{d}", "en", "a") for i, d in enumerate(licences.DECOYS)] + [(200 + i, prose(200), "en", "a") for i in range(50)]
    docs = docs_of(spark, rows)
    got = licence_scan.licence_scan(docs, model).where("confirmed").collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(i, f) for i, (f, _) in enumerate(seen)}
    for row in got:
        assert seen[row["doc_id"]][1] in rows[row["doc_id"]][1][row["start"] : row["end"]]
    assert licence_scan.licence_scan(empty, model).count() == 0


def test_licence_training_takes_lines_of_a_sample(spark, awkward, empty):
    """The background is what plain Python takes of the documents of the least hash, and a model trained on it finds notices and nothing else."""
    r = random.Random(14)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, "\n".join(r.choice([some(9), some(3), "", " ", "Released under the MIT License.", f"{some(4)} Licensed under the GNU GPL v3."]) for _ in range(r.randint(1, 20))), "en", "a") for i in range(60)]
    docs = docs_of(spark, rows + rows[:9] + [(None, some(5), "en", "a"), (70, None, "en", "a")])
    ids = sorted((x["h"], x["doc_id"]) for x in docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h")).collect())
    picked = {d for _, d in ids[:20]}
    want = set()
    for d, t, *_ in rows:
        own = [x for x in t.split("\n") if x.strip() and "MIT" not in x and "GPL" not in x]
        step = max(1, -(-len(own) // 4))
        want |= {(d, x) for x in own[::step] if d in picked}
    got = licence_scan.background(docs, 20, 4, 5).collect()
    assert {(x["doc_id"], x["x"]) for x in got} == want and len(got) == len(want)
    model = licence_scan.train_on(docs, 20, 4, 5)
    found = licence_scan.licence_scan(docs, model).where("confirmed").collect()
    assert {(x["doc_id"], x["start"]) for x in found} == {(d, sum(len(y) + 1 for y in t.split("\n")[:k])) for d, t, *_ in rows for k, x in enumerate(t.split("\n")) if "MIT" in x or "GPL" in x}
    for docs in (awkward, empty):
        assert licence_scan.licence_scan(awkward, licence_scan.train_on(docs)).where("confirmed").count() == 0


def test_licences_awkward(awkward, model):
    assert licence_scan.licence_scan(awkward, model).count() == 0
    texts = awkward.withColumn("text", F.concat(F.lit("Released under the MIT License.\r\n"), "text"))
    assert licence_scan.licence_scan(texts, model).where("confirmed and start = 0").count() == 12


# text kernels


def test_tokens_and_grams():
    texts = ["a b  c\td", "", "é x", "  ", "one two three four"]
    t = K.tokens(pa.record_batch({"text": pa.array(texts)}))
    assert t.counts.tolist() == [4, 0, 2, 0, 4]
    g, r = K.grams(t, 3)
    assert np.bincount(r, minlength=5).tolist() == [2, 0, 1, 0, 2] and len(set(g.tolist())) == 5


def test_stages_on_awkward_rows(spark, awkward, empty):
    for stage in (stages.near_duplicates, stages.suffixes, stages.mix):
        assert stage(spark, awkward, "").columns == awkward.columns
        assert stage(spark, awkward, "").count() > 5 and stage(spark, empty, "").count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(21)
    a, b, c, d, e = (" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, a), (None, d), (None, d), (4, d), (7, e), (7, None), (7, None), (9, e), (None, b + " x"), (None, "")]
    got = stages.near_duplicates(spark, docs_of(spark, [(i, t, "en", "a") for i, t in rows]), "").collect()
    want = [(1, a), (2, b), (3, c), (4, d), (7, e), (7, None), (None, "")]
    assert sorted(map(repr, ((x["doc_id"], x["text"]) for x in got))) == sorted(map(repr, want))
    assert all(x["row"] == x["_hash"] == "mine" for x in got)

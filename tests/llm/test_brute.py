"""The queries and the pipeline's stages against plain versions that take one row, one pair or one merge at a time."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retrova.llm import licences, mcd_rules, merge_dropout, mixing, quality_bayes, queries, stages
from retrova.llm import textkit as K

from test_operators import brute_links, brute_spans

U = np.uint64
M64 = (1 << 64) - 1


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# op1


def test_op1_suffix_array_dedup(spark, sf_dir, rows):
    want = defaultdict(int)
    for (d, _), n in brute_spans(rows, 50).items():
        want[d] += n
    got = queries.op1_suffix_array_dedup(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == dict(want) and got


# op2


def plain_rates(scored):
    """(host, path) to (path rate, host rate, global rate) of (host, path, p) rows."""
    paths, hosts = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for h, p, x in scored:
        for at in (paths[h, p], hosts[h]):
            at[0] += x
            at[1] += 1
    g = (sum(x for *_, x in scored) + 1) / (len(scored) + 2)

    def strength(groups):
        """groups: (rate, n, prior)."""
        n = sum(k for _, k, _ in groups)
        spread = sum(k * (r - q) ** 2 for r, k, q in groups)
        noise = sum(q * (1 - q) for *_, q in groups)
        between = max(1e-6, (spread - noise) / max(1.0, n - sum(k * k for _, k, _ in groups) / n))
        var = max(1e-9, sum(q * (1 - q) for *_, q in groups) / len(groups))
        return max(2.0, min(1e6, var / between - 1))

    a = strength([(s / n, n, g) for s, n in hosts.values()])
    host = {h: (s + a * g) / (n + a) for h, (s, n) in hosts.items()}
    b = strength([(s / n, n, host[h]) for (h, _), (s, n) in paths.items()])
    return {(h, p): ((s + b * host[h]) / (n + b), host[h], g) for (h, p), (s, n) in paths.items()}


def logit(p):
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def plain_quality(model, rows):
    """(doc_id, evidence, path rate, host rate, quality) of rows, one text at a time."""
    evidence = []
    for _, t, *_ in rows:
        data = (t or "").encode()
        evidence.append(float(model.log_odds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]))
    rates = plain_rates([(s, la, 1 / (1 + math.exp(-e))) for (_, _, la, s), e in zip(rows, evidence, strict=True)])
    out = []
    for (d, _, la, s), e in zip(rows, evidence, strict=True):
        p, h, g = rates[s, la]
        out.append((d, e, p, h, 1 / (1 + math.exp(-(e + logit(p) - logit(g))))))
    return out


def trained(spark, sf_dir):
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return quality_bayes.train_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), good, max_train=4000)


def test_op2_quality_bayes(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in queries.op2_quality_bayes(spark, sf_dir).collect()}
    want = [w for w in plain_quality(trained(spark, sf_dir), rows) if w[-1] >= 0.6]
    assert got.keys() == {w[0] for w in want} and 50 < len(got) < len(rows)
    for d, e, p, h, q in want:
        r = got[d]
        assert [r["evidence"], r["path_rate"], r["host_rate"], r["quality"]] == pytest.approx([e, p, h, q], rel=1e-6, abs=1e-9)


def test_evidence_is_a_sum_over_words():
    """Each weighted word that a text has counts once, whatever its case and the marks about it."""
    names = [f"word{i}" for i in range(30)]
    tok = quality_bayes.words(*K.utf8(pa.array(names)))
    order = np.argsort(tok.hash)
    weight = np.random.default_rng(1).normal(size=30)
    n = quality_bayes.SHAPES
    model = quality_bayes.Model(tok.hash[order], weight[order], np.zeros(n), np.ones(n), np.zeros(n), 0.25)
    r = random.Random(2)
    texts = [" ".join(r.choice([w, w.upper(), f"({w},", f"{w}!", "other", "wördß"]) for w in r.choices(names, k=r.randint(0, 40))) for _ in range(50)]
    for t, x in zip(texts, model.log_odds(*K.utf8(pa.array(texts))), strict=True):
        held = {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()}
        assert x == pytest.approx(0.25 + sum(v for w, v in zip(names, weight, strict=True) if w in held))


# op3


def plain_mcd(x, h=0.75, steps=30):
    """Mean, covariance and log determinant of the h-share of rows whose covariance has the least determinant, from many starts, with every distance sorted."""
    r, best, n = np.random.default_rng(0), None, len(x)
    k = math.ceil(h * n)
    unit = x / mcd_rules.FLOOR
    starts = [np.argsort(((unit - np.median(unit, 0)) ** 2).sum(1))[:k]] + [r.choice(n, 3 * mcd_rules.P, replace=False) for _ in range(60)]
    for at in starts:
        for _ in range(steps):
            white, det, df = mcd_rules._whitening(np.cov(x[at].T, bias=True))
            d = (((x - x[at].mean(0)) @ white.T) ** 2).sum(1)
            new = np.argsort(d, kind="stable")[:k]
            if set(new) == set(at):
                break
            at = new
        if best is None or det < best[0]:
            best = det, d, df
    return best


def test_robust_distances_are_those_of_the_exact_determinant(spark):
    """Two groups with planted outliers: the outcome is that of an exhaustive search with exact distances, all but a few texts at the cut."""
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(80)]
    text = lambda odd: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", "."]) + ("#$%^@" if odd and r.random() < 0.8 else "") for _ in range(r.randint(40, 200)))
    made = [(i, text(i % 9 == 0), "en" if i % 2 else "fr", "s") for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in mcd_rules.robust_distances(docs, h=0.75, steps=4, least=100).collect()}
    cut = mcd_rules.chi2_quantile(0.9999, mcd_rules.P)
    for lang in ("en", "fr"):
        own = [m for m in made if m[2] == lang]
        x = mcd_rules.statistics(*K.utf8(pa.array([m[1] for m in own])))
        assert np.allclose(x, [[got[m[0]][s] for s in mcd_rules.STATS] for m in own])
        _, d, df = plain_mcd(x)
        scale = max(0.5, np.median(d) / (df * (1 - 2 / (9 * df)) ** 3))
        mine = np.array([got[m[0]]["distance"] for m in own])
        assert ((mine > cut) == (d / scale > cut)).mean() >= 0.985 and np.corrcoef(np.log(mine), np.log(d))[0, 1] > 0.98
        planted = np.array([m[0] % 9 == 0 for m in own])
        assert (mine[planted] > cut).all() and (d[planted] / scale > cut).all() and (mine[~planted] > cut).mean() < 0.02
        assert {got[m[0]]["level"] for m in own} == {2}


def test_op3_mcd_rules(spark, sf_dir, rows):
    """The query keeps what the operator puts within the quantile: here each distance is worked out anew from the statistics of the whole table."""
    kept = {r["doc_id"]: r for r in queries.op3_mcd_rules(spark, sf_dir).collect()}
    every = mcd_rules.robust_distances(spark.read.parquet(f"{sf_dir}/documents.parquet"), h=0.75, steps=4, least=200).collect()
    cut = mcd_rules.chi2_quantile(0.9999, mcd_rules.P)
    assert len(every) == len(rows) and kept.keys() == {r["doc_id"] for r in every if r["distance"] <= cut}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert len(bad - kept.keys()) > 0.8 * len(bad) and len(good & kept.keys()) > 0.95 * len(good)


# op4


def mix64(x):
    return int(K.mix(np.array([x & M64], U))[0])


def plain_encoding(v, doc_id, text, dropout, seed):
    """One text's ids: units one after another, and of each the best merge that isn't skipped, one at a time."""
    if not text:
        return []
    data = " " + text
    units, at = [], 0
    for i in range(1, len(data)):
        if (data[i] == " " and data[i - 1] != " ") or data[i] == "\n" or data[i - 1] == "\n":
            units.append(data[at:i])
            at = i
    units.append(data[at:])
    who = mix64(doc_id)
    out = []
    for nth, unit in enumerate(units):
        raw = unit.encode()
        name = mix64(sum((b + 1) * pow(K._BASE, i, 1 << 64) for i, b in enumerate(raw)) + len(raw))
        key = mix64(name ^ (seed * 0x2545F4914F6CDD1D % 2**64))
        if dropout:
            key = mix64(key + mix64(who ^ mix64(nth + seed)))
        parts = [(int(v.char[ord(c)]), k, k + 1, c) for k, c in enumerate(unit)]
        while True:
            best = None
            for i in range(len(parts) - 1):
                a, b = parts[i], parts[i + 1]
                if a[0] < 0 or b[0] < 0:
                    continue
                piece = int(v.merge(np.array([a[0]], np.int32), np.array([b[0]], np.int32))[0])
                if piece < 0:
                    continue
                where = mix64(((a[1] << 42) ^ (b[1] << 21) ^ b[2]) + 0x51ED270B)
                if dropout and mix64(key ^ where) < int(dropout * 2**64):
                    continue
                if best is None or v.rank[piece] < best[0]:
                    best = (v.rank[piece], i, piece)
            if best is None:
                break
            _, i, piece = best
            parts[i : i + 2] = [(piece, parts[i][1], parts[i + 1][2], parts[i][3] + parts[i + 1][3])]
        for piece, *_, chars in parts:
            out += [piece] if piece >= 0 else [int(v.byte[b]) for b in chars.encode()]
    return out


def test_op4_merge_dropout(spark, sf_dir, rows):
    v = merge_dropout.vocabulary(merge_dropout.default_model())
    got = {r["doc_id"]: r for r in queries.op4_merge_dropout(spark, sf_dir).collect()}
    assert len(got) == len(rows) and all(r["lossless"] for r in got.values())
    some = sorted((r for r in rows if r[1]), key=lambda r: len(r[1]))[::3][:25]
    for d, t, *_ in some:
        assert got[d]["ids"] == plain_encoding(v, d, t, 0.1, 17), d
    plain = sum(len(plain_encoding(v, d, t, 0, 17)) for d, t, *_ in some)
    assert sum(got[d]["n_tokens"] for d, *_ in some) > 1.05 * plain


def test_merge_dropout_on_odd_texts(spark):
    v = merge_dropout.vocabulary(merge_dropout.default_model())
    odd = ["\n\n a  b\n", "😀日本語" * 9, "x" * 90, "naïve   façade\t-- ok", " ", "Ünïcödé▁mix"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in merge_dropout.encode_documents(docs, dropout=0.4, seed=5).collect():
        assert r["ids"] == plain_encoding(v, r["doc_id"], odd[r["doc_id"]], 0.4, 5) and r["lossless"]


# op7


def plain_copies(spark, docs, sources, weights, epochs, seed):
    """Row to copies: capacities, quotas and flow in floats, draws one by one."""
    names = sorted(weights)
    flags = docs.select("doc_id", "text", *[sources[s].alias(f"s_{s}") for s in names], F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(mixing.FINE)).alias("draw")).collect()
    pattern = ["".join("1" if r[f"s_{s}"] else "0" for s in names) for r in flags]
    tokens = [len((r["text"] or "").split()) for r in flags]
    held = Counter()
    for p, n in zip(pattern, tokens, strict=True):
        held[p] += n
    held = {p: float(held[p]) for p in set(pattern)}
    budget = epochs * sum(n for p, n in held.items() if "1" in p)
    flow, _ = mixing.min_cost_flow(held, [budget * weights[s] / sum(weights.values()) for s in names])
    out = {}
    for p in held:
        mine = [i for i, x in enumerate(pattern) if x == p]
        rate = sum(flow[p]) / held[p] if held[p] and "1" in p else float("1" not in p)
        whole = int(rate + 1e-9)
        want = max(0.0, rate - whole) * held[p]
        slices = Counter()
        for i in mine:
            slices[flags[i]["draw"] // mixing.WIDTH] += tokens[i]
        until, left = 0 if want < 1e-6 else mixing.FINE, want
        if want >= 1e-6:
            for k in sorted(slices):
                if left < slices[k]:
                    until = k * mixing.WIDTH + int(mixing.WIDTH * left / slices[k])
                    break
                left -= slices[k]
        for i in mine:
            if c := whole + (flags[i]["draw"] < until):
                out[flags[i]["doc_id"]] = out.get(flags[i]["doc_id"], 0) + c
    return out


def test_op7_flow_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["copies"] for r in queries.op7_flow_mixing(spark, sf_dir).collect()}
    assert got == plain_copies(spark, docs, stages.sources(), stages.WEIGHTS, stages.EPOCHS, 17) and len(got) > 50


# op8


def test_op8_licence_scan(spark, sf_dir, rows):
    """Confirmed lines are those that name a licence, by a plain search of all lines for the families' names."""
    found = [r for r in queries.op8_licence_scan(spark, sf_dir).collect() if r["confirmed"]]
    text = {d: t for d, t, *_ in rows}
    names = sorted({n.lower() for names in licences.NAMES.values() for n in names}, key=len, reverse=True)
    frames = [f.split("{}")[0].strip().lower() for f in licences.FRAMES if len(f.split("{}")[0].split()) > 1]
    want = set()
    for d, t, *_ in rows:
        at = 0
        for line in (t or "").split("\n"):
            low = line.lower()
            if any(f in low for f in frames) and any(n in low for n in names):
                want.add((d, at))
            at += len(line) + 1
    assert {(r["doc_id"], r["start"]) for r in found} == want and want
    for r in found:
        line = text[r["doc_id"]][r["start"] : r["end"]].lower()
        assert any(n.lower().split()[0] in line for n in licences.NAMES[r["family"]])


# op10


def plain_label(x, before):
    d = x ^ before
    k = (d & -d).bit_length() - 1
    return 2 * k + (x >> k & 1)


def plain_level(symbols, first):
    """One level over [(name, first byte)] of one text."""
    runs = []
    for x, b in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][2] += 1
        else:
            runs.append([x, b, 1])
    labels_of = [r[0] for r in runs]
    named = []
    for x, _, n in runs:
        x = mix64(x + 1) if first else x
        named.append(mix64((x * 0xA24BAED4963EE407 + n) & M64) if n > 1 else x)
    lab = labels_of if first else named
    for _ in range(4):
        lab = [plain_label(x, lab[i - 1] if i else x ^ 1) for i, x in enumerate(lab)]
    for v in (3, 4, 5):
        old = list(lab)
        for i, x in enumerate(old):
            if x == v:
                near = {old[i - 1] if i else 9, old[i + 1] if i + 1 < len(old) else 9}
                lab[i] = min({0, 1, 2} - near)
    n = len(lab)
    inner = range(1, n - 1)
    top = {i for i in inner if lab[i - 1] < lab[i] > lab[i + 1]}
    heads = {0} | top | {i for i in inner if lab[i - 1] > lab[i] < lab[i + 1] and i - 1 not in top and i + 1 not in top}
    heads = sorted(heads)
    out = []
    for a, b in zip(heads, [*heads[1:], n], strict=True):
        total = sum(named[a + q] * pow(0xA24BAED4963EE407, q, 1 << 64) for q in range(b - a)) + (b - a)
        out.append((mix64(total), runs[a][1]))
    return out


def test_op10_phrase_fingerprints(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in queries.op10_phrase_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for d, t, *_ in sorted(rows, key=lambda r: len(r[1] or ""))[::6][:22]:
        symbols, k, kept = [(b, i) for i, b in enumerate(t.encode())], 0, []
        while symbols:
            symbols = plain_level(symbols, k == 0)
            k += 1
            if k == 5:
                kept = symbols
            if len(symbols) == 1 and k >= 5:
                break
        assert got[d]["names"] == [signed(x) for x, _ in kept] and got[d]["starts"] == [b for _, b in kept], d
        if kept and len(symbols) == 1 and got[d]["height"] == k:
            assert got[d]["fingerprint"] == signed(symbols[0][0])
    same = defaultdict(set)
    for d, t, *_ in rows:
        same[t].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


# the pipeline, stage by stage


def test_pipeline_by_stage(spark, sf_dir, tmp_path):
    """Each stage's rows follow from its own input as plain versions work them out, and run() gives the last one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs if not k else kept[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    quality, near, cut, mix, ids = kept
    assert all(x.columns == docs.columns for x in kept[:4])
    first = rows_of(docs)
    good = {w[0] for w in plain_quality(trained(spark, sf_dir), first) if w[-1] >= 0.6}
    assert {r[0] for r in rows_of(quality)} == {d for d, t, *_ in first if d in good and t is not None}
    second = rows_of(quality)
    gone = {d for d, c, _ in brute_links(second, 3, 1, 2) if d != c}
    third = rows_of(near)
    assert sorted(r[0] for r in third) == sorted(r[0] for r in second if r[0] not in gone) and gone
    covered = brute_spans(third, 50)
    fourth = {r["doc_id"]: r["text"] for r in cut.collect()}
    for d, t, *_ in third:
        left = len(t.split()) - covered.get((d, t), 0)
        assert len(fourth.get(d, "").split()) == left, d
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert Counter(r["doc_id"] for r in mix.collect()) == plain_copies(spark, cut, stages.sources(), stages.WEIGHTS, stages.EPOCHS, 17)
    v = merge_dropout.vocabulary(merge_dropout.default_model())
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert Counter(r["doc_id"] for r in ids.collect()) == Counter(r["doc_id"] for r in mix.collect())
    for d, t in sorted(fourth.items(), key=lambda x: len(x[1]))[:8]:
        assert got.get(d, plain_encoding(v, d, t, 0.1, 17)) == plain_encoding(v, d, t, 0.1, 17)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in whole) == sorted((r["doc_id"], tuple(r["ids"])) for r in ids.collect())

"""Whole results of the queries that SQL cannot express, against plain versions that share no step with the operators."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer

from quittance.llm import decontaminate, lm_score, packing, quality, queries, secret_scan, token_files, toxicity, url_filter
from quittance.llm.common import spread_join
from quittance.llm.components import components

from .test_contract import AWKWARD, SF, docs, empty, frame, lowered, sample, spaced  # noqa: F401  fixtures


def held(doc_id, modulus=7, rest=2):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == rest


# --- 2 ---------------------------------------------------------------------------------------


def brute_scores(rows):
    """Deleted interpolation by the module's description, over strings."""
    texts = [(i, held(i), [*spaced(lowered(t)), None]) for i, t in rows]
    uni = Counter(w for _, h, ws in texts if not h for w in ws)
    bi = Counter(p for _, h, ws in texts if not h for p in zip(["<s>", *ws], ws))
    n, v, starts = sum(uni.values()), len(uni), sum(not h for _, h, _ in texts)
    context = lambda w: starts if w == "<s>" else uni[w]
    bucket = lambda c: min(int(c).bit_length(), 23)
    binned = lambda r, bins: math.exp((min(max(math.floor((math.log(r) + 8) / 0.25), 0), bins - 2) + 0.5) * 0.25 - 8) if r > 0 else 0.0
    seen = {}
    for _, h, ws in texts:
        for a, w in zip(["<s>", *ws], ws) if not h else ():
            c = context(a) - 1
            pair = (bi[a, w] - 1) / c if c > 0 else 0.0
            seen.setdefault(bucket(c), []).append((binned(pair * (v + 1), 128), binned((uni[w] - 1) / max(n - 1, 1) * (v + 1), 128), 1.0))
    weights = {}
    for b, parts in seen.items():
        p, w = np.array(parts), np.ones(3) / 3
        for _ in range(200):
            share = p * w
            new = (share / share.sum(1, keepdims=True)).mean(0)
            done, w = np.abs(new - w).max() < 1e-7, new
            if done:
                break
        weights[b] = (w + 1e-6) / (1 + 3e-6)
    known = sorted(weights)
    for b in range(1, 24):
        weights.setdefault(b, weights[min(known, key=lambda k: (abs(k - b), k))] if known else np.array([0, 0.9, 0.1]))
    weights.setdefault(0, np.array([0, 0.9, 0.1]))
    out = []
    for i, h, ws in texts:
        total = 0.0
        for a, w in zip(["<s>", *ws], ws):
            c = context(a)
            x, y, z = weights[bucket(c)]
            total += math.log10(x * bi[a, w] / max(c, 1) + y * uni[w] / max(n, 1) + z / (v + 1))
        out.append((str(i), h, round(total, 3)))
    return sorted(out)


def test_lm_scores(spark, docs, sample):  # noqa: F811
    for rows, df in ((AWKWARD, docs), (sample, frame(spark, sample))):
        got = lm_score.score_texts(df, queries.crc_mod(F.col("doc_id"), 7) == 2, block_bytes=30_000).collect()
        for (i, h, x), (j, k, y) in zip(sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 3)) for r in got), brute_scores(rows)):
            assert (i, h) == (j, k) and abs(x - y) <= 2e-3 + 1e-6 * abs(y)


# --- 3 ---------------------------------------------------------------------------------------


def brute_toxicity(rows, labels, k=15):
    """Dense cosines of every row with every example."""
    marked = {}
    for i, y in labels:
        marked[i] = max(marked.get(i, 0), y)
    bags = [toxicity.terms_of((t or "").encode()) for _, t in rows]
    examples = {}
    for n, (i, _) in enumerate(rows):
        if i in marked:
            examples.setdefault(i, n)
    ids = sorted(examples)
    terms = sorted(set().union(*[bags[examples[i]] for i in ids]))
    place = {t: j for j, t in enumerate(terms)}
    df = np.array([sum(t in b for b in bags) for t in terms])
    vectors = [(np.array(sorted(place[t] for t in bags[examples[i]]), np.int64),) * 2 for i in ids]
    vectors = [(t, np.array([bags[examples[i]][terms[j]] for j in t], np.int64)) for i, (t, _) in zip(ids, vectors)]
    ys = [marked[i] for i in ids]
    scale = (np.log((1 + len(rows)) / (1 + df)) + 1) * toxicity.class_weights(vectors, ys, len(terms))

    def dense(bag):
        x = np.zeros(len(terms))
        for t, c in bag.items():
            if t in place:
                x[place[t]] = (1 + math.log(c)) * scale[place[t]]
        norm = math.sqrt((x * x).sum())
        return x / norm if norm else x

    matrix = np.array([dense(bags[examples[i]]) for i in ids])
    totals = Counter(marked.values())
    prior = totals[1] / sum(totals.values())
    share = [totals[y] / max(1, ys.count(y)) / max(1.0, sum(totals.values()) / len(ys)) for y in (0, 1)]

    def vote(bag, without):
        sims = (matrix @ dense(bag)).round(9)
        near = sorted((-s, i, y) for s, i, y in zip(sims, ids, ys) if s > 0 and i != without)[:k]
        parts = [(-s / (1.05 + s) * share[y], y) for s, _, y in near] + [(0.5 / 0.55, prior)]
        p = sum(w * y for w, y in parts) / sum(w for w, _ in parts)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p)), [(i, round(-s, 6)) for s, i, _ in near]

    x = np.array([vote(bags[examples[i]], i)[0] for i in ids])
    slope, intercept = toxicity.logistic(x, np.array(ys, float), np.array([share[y] for y in ys]))
    out = []
    for (i, _), bag in zip(rows, bags):
        z, near = vote(bag, i)
        out.append((str(i), 1 / (1 + math.exp(-(slope * z + intercept))), near))
    return out


def test_toxicity_whole(spark, sample):  # noqa: F811
    """The sample and the awkward rows with a fitted model: scores and neighbours; repeated ids have one text each here."""
    awkward = [(None if i is None else 10**6 + i, t) for i, t in dict(AWKWARD).items()]
    rows = sample + awkward
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()] + [(10**6 + 7, 1), (10**6 + 8, 0), (10**6 + 2, 0), (10**6 + 4, 1)]
    got = toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = {i: (s, near) for i, s, near in brute_toxicity(rows, labels)}
    assert len(got) == len(rows)
    for r in got:
        score, near = want[str(r["row"]["doc_id"])]
        found = [(n["doc_id"], round(n["similarity"], 6)) for n in r["out"]["neighbours"]]
        assert abs(r["out"]["score"] - score) < 1e-6 and [s for _, s in found] == pytest.approx([s for _, s in near], abs=2e-6)
        assert r["row"]["doc_id"] not in [i for i, _ in found]


# --- 4 ---------------------------------------------------------------------------------------


def test_decontamination_with_clashing_columns(spark, empty):  # noqa: F811
    names = ["row", "out", "number", "__row", "text", "item", "window"]
    df = spark.createDataFrame([(1, *"abcd", "one two three", "x", "y"), (1, *"abcd", "one two three", "x", "y"), (2, *"abcd", None, "x", "y")], ["doc_id", *names])
    items = spark.createDataFrame([(1, "one two"), (2, "two three")], "item_id long, text string")
    for size in (1 << 20, 5):
        got = decontaminate.decontaminate(df, items, ["doc_id", "row", "__row", "number"], block_bytes=size).select("row.doc_id", "row.__row", "out.n_hit").collect()
        assert sorted(map(tuple, got)) == [(1, "d", 3), (1, "d", 3), (2, "d", 0)]
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert [r["out"]["n_hit"] for r in decontaminate.decontaminate(df, items.where("false")).collect()] == [0, 0, 0]


# --- 5 ---------------------------------------------------------------------------------------


def brute_battery(run):
    """encoding, length, p of a run, by the textbook formulas."""
    name, alphabet = next(((n, a) for n, fits, a in secret_scan.ENCODINGS if re.search(fits, run)), (None, None))
    if name is None:
        return None
    body = re.sub("=+$", "", run)
    body = body.lower() if name == "hex" else body
    n, k = len(body), len(alphabet)
    counts = Counter(body)
    chi = max(0.0, sum((counts[a] - n / k) ** 2 / (n / k) for a in alphabet))
    part = 2 / (9 * (k - 1))
    z = [((chi / (k - 1)) ** (1 / 3) - (1 - part)) / math.sqrt(part)]
    values = [alphabet.index(c) + 1 - (k + 1) / 2 for c in body]
    high = sum(v > 0 for v in values)
    turns = 1 + sum((a > 0) != (b > 0) for a, b in zip(values, values[1:]))
    mean = 2 * high * (n - high) / n + 1
    z.append((turns - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    z.append(sum(a * b for a, b in zip(values, values[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    tail = lambda x: math.erfc(x / math.sqrt(2)) / 2
    half = -sum(math.log(max(min(p, 1.0), 1e-12)) for p in (tail(z[0]), 2 * tail(abs(z[1])), 2 * tail(abs(z[2]))))
    return name, n, math.exp(-half) * (1 + half + half * half / 2)


def brute_secrets(rows, fdr=0.1, least=4):
    """All spans of each row."""
    found = []
    for i, t in rows:
        t = (t or "").replace("\x01", "\x02")
        base = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(secret_scan.BASE_RULES) for m in re.finditer(p, t) if len(m[g]) >= n)
        runs = [(m.start(), m.end(), brute_battery(m[0])) for m in re.finditer(secret_scan.RUN, t) if re.search("[0-9]", m[0]) or re.search("[a-z][A-Z]", m[0])]
        found.append((i, base, [r for r in runs if r[2] and not any(a < r[1] and r[0] < b for a, _, b in base)]))
    band = lambda n: sum(n >= x for x in secret_scan.BANDS) - 1
    cells = {}
    for _, _, runs in found:
        for _, _, (name, n, p) in runs:
            cells.setdefault((name, band(n)), []).append(int(min(p, 0.999999) * 100))
    cut = {}
    for key, steps in cells.items():
        random_runs = min(len(steps), 2 * sum(s >= 50 for s in steps))
        if random_runs < least:
            cut[key] = secret_scan.STRICT[key[1]]
            continue
        ok = [t for t in range(1, 100) if (flagged := sum(s >= t for s in steps)) and 1 - min(1.0, random_runs * (1 - t / 100) / flagged) <= fdr]
        cut[key] = min(ok) / 100 if ok else 2.0
    out = []
    for i, base, runs in found:
        added = [(a, 3, b) for a, b, (name, n, p) in runs if p >= cut[name, band(n)]]
        out.append((str(i), sorted(base + added)))
    return sorted(out), cells


def test_secret_spans_whole(spark, docs, sample):  # noqa: F811
    r = random.Random(9)
    kinds = ["0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    made = [(10_000 + i, f"x {''.join(r.choice(r.choice(kinds)) for _ in range(r.choice([20, 22, 26, 30, 40, 55, 80, 200, 600])))} y {'The' * r.randrange(8, 20)}1 z") for i in range(150)]
    made += [(11_000 + i, " ".join("".join(r.choice(k) for _ in range(r.randrange(20, 90))) for k in kinds)) for i in range(60)]
    for rows in (AWKWARD, sample, made):
        got = [(str(x["row"]["doc_id"]), [(s["start"], s["rank"], s["end"]) for s in x["spans"]]) for x in secret_scan.scan(frame(spark, rows)).collect()]
        want, cells = brute_secrets(rows)
        assert sorted(got) == want
    assert sum(any(k == 3 for _, k, _ in s) for _, s in want) > 100 and len(cells) > 8


# --- 7 ---------------------------------------------------------------------------------------


def test_many_matches_in_one_text(spark):
    """The work is near linear in the matches; spans and redaction are those of a plain loop."""
    seconds = {}
    for n in (1000, 16_000):
        text = "😀" + " ".join(f'é password = "abcdefgh{i:06d}" deadbeef{i:016x}' for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = secret_scan.find_spans(df, {}, ("text",))
        began = time.time()
        spans, clean = found.select("spans", secret_scan.redacted(F.col("row.text"), F.col("spans"))).collect()[0]
        seconds[n] = time.time() - began
        assert len(spans) == 2 * n and clean == "😀" + " ".join(['é [assign]" [hex]'] * n)
        assert all(text[s["start"] : s["end"]].startswith(("password", "deadbeef")) for s in spans)
    assert seconds[16_000] < 2 * 16 * seconds[1000]


def test_spans_beside_each_other(spark):
    r = random.Random(9)
    for _ in range(4):
        base = sorted((a, r.randrange(3), a + r.randrange(1, 30)) for a in (r.randrange(900) for _ in range(r.randrange(1, 40))))
        at, runs = 0, []
        while at < 900:
            runs.append((at, 3, at + r.randrange(1, 12), f"r{at}"))
            at = runs[-1][2] + r.randrange(4)
        df = spark.createDataFrame([(base, runs)], "base array<struct<start:int,rank:int,end:int>>, runs array<struct<start:int,rank:int,end:int,run:string>>")
        got = df.select(secret_scan.outside(F.col("runs"), F.col("base"))).collect()[0][0]
        assert [tuple(x) for x in got] == [x for x in runs if not any(b[0] < x[2] and x[0] < b[2] for b in base)]


def test_url_filter_lists(spark):
    """The index against running every rule; awkward tables."""
    r, parts = random.Random(3), ["ads", "casino", "x", "foo", "bar1", "wp", "a", "track", "img"]

    def line():
        body = r.choice(["||", "||", "|http://", "", "*", "/"]) + r.choice(parts)
        for _ in range(r.randrange(1, 3)):
            body += r.choice([".", "-", "/", "*", "^", "_"]) + r.choice(parts)
        return ("@@" if r.random() < 0.1 else "") + body + r.choice(["^", "|", "*", ".", ""]) + r.choice(["", "$third-party,image"])

    rules = url_filter.filter_rules(["! comment", "", "##.banner", "/img[0-9]+/", *[line() for _ in range(60)]])
    hosts = [url_filter.HostRule(r.choice(["allow", "block"]), f"{r.choice(parts)}.{r.choice(parts)}", f"/{r.choice(parts)}") for _ in range(150)]
    urls = [f"http://{'.'.join(r.choice(parts) for _ in range(r.randrange(1, 4)))}/{r.choice('/-._?').join(r.choice(parts) for _ in range(r.randrange(4)))}" for _ in range(600)]
    urls += [None, "", "no scheme", urls[0], urls[0], "http://img7"]
    df = spark.createDataFrame([(k if k % 9 else None, u, "r", "o", "h") for k, u in enumerate(urls)], "page_id long, url string, row string, out string, beside string")
    got = url_filter.filter_urls(df, hosts, rules, ["page_id", "url", "row"]).collect()
    assert len(got) == len(urls) and Counter(x["row"]["url"] for x in got) == Counter(urls)
    verdicts = Counter()
    for x in got:
        url = x["row"]["url"]
        host, path = url_filter.split_url(url)
        fit = [h for h in hosts if ("." + host).endswith("." + h.host) and path.startswith(h.path)]
        best = max(fit, key=lambda h: (len(h.name), h.name, h.verdict), default=None)
        kinds = {f.verdict for f in rules if re.search(f.pattern, (url or "").lower())}
        assert (x["out"]["rule"], x["out"]["verdict"]) == (best.name if best else None, best.verdict if best else "block" if kinds == {"block"} else "allow")
        verdicts[best is None, x["out"]["verdict"]] += 1
    assert len(verdicts) == 4 and min(verdicts.values()) > 3
    assert url_filter.filter_urls(df.where("false"), hosts).count() == 0


def test_filter_syntax():
    fits = lambda line, url: bool(re.search(url_filter.filter_rule(line).pattern, url))
    assert fits("||ads.example^", "https://a.ads.example/x") and not fits("||ads.example^", "https://bads.example/x") and not fits("||ads.example^", "https://ads.examples/")
    assert fits("|http://x", "http://xy") and not fits("|http://x", "see http://x") and fits("/ad*.js|", "http://h/ad-1.js") and not fits("/ad*.js|", "http://h/ad.js?1")
    assert url_filter.filter_rule("@@||x.com^").verdict == "allow" and url_filter.filter_rule("/a[0-9]/").pattern == "(?i:a[0-9])"
    assert [url_filter.filter_rule(x) for x in ("! no", "", "[Adblock]", "x.com##.ad")] == [None] * 4
    assert url_filter.filter_rule("||x.ads*foo/bar").tokens == ("x", "foo")[:1]
    # classes of regular expressions keep their case; options that narrow a rule leave it out
    assert fits(r"/ads\D+x/", "http://h.net/adsabcx/") and not fits(r"/ads\D+x/", "http://h.net/ads123x/") and fits("/ADS[A-C]/", "http://h/adsb")
    lines = ["@@*$elemhide", "||ads.com^$domain=a.com", "||ads.com^$third-party", "||all.com^$all,important", "/a$b/", "||x.com^$~script", "! $x", "x$document"]
    assert [bool(url_filter.filter_rule(x)) for x in lines] == [False, False, False, True, True, False, False, True]
    assert url_filter.skipped_rules(lines) == [lines[0], lines[1], lines[2], lines[5]] and url_filter.skipped_rules(url_filter.DEFAULT_LIST.splitlines()) == []


# --- 8 ---------------------------------------------------------------------------------------


def test_token_file_checksum():
    import io

    data = token_files.encode_file([1, None], [2, 1], np.array([7, 2, 2], "<u4").tobytes())
    token_files.TokenFile(io.BytesIO(data), len(data)).verify()
    broken = bytearray(data)
    broken[9] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(bytes(broken)), len(broken)).verify()


def test_token_files_are_read_by_many_tasks(spark):
    df = frame(spark, [(i if i % 3 else None, "some words here " * 40) for i in range(400)]).repartition(4)
    folder = f"file:///tmp/quittance-test-{random.random()}"
    manifest = token_files.write_token_files(df, tokenizer("word_bpe_49k.json"), folder, file_ids=2000)
    files = manifest.count()
    out = token_files.read_token_files(manifest, folder, False)
    assert files > 8 and out.rdd.getNumPartitions() == files and out.count() == 400


# --- 9 ---------------------------------------------------------------------------------------


def test_placement_minimises_the_squares():
    """Every placement leaves the least sum of squared counts of the levels; of equal ones the fullest window is taken."""
    r, length = random.Random(5), 24
    packer = packing.Packer(length, 10**9)
    for _ in range(3000):
        size = r.choice([1, 2, 3, 5, 8, 11, 13, 20, 23])
        counts = packer.counts.copy()
        options = []
        for level in range(length - size + 1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            if level + size < length:
                after[level + size] += 1
            options.append((int((after[1:length].astype(int) ** 2).sum()), -level))
        assert packer.level_for(size) == -min(options)[1]
        packer.add(1, b"\x00\x00\x00\x00" * size)
        held = Counter(level for level, windows in packer.levels.items() for _ in windows)
        assert all(packer.counts[level] == held[level] for level in range(1, length))


# --- 10 --------------------------------------------------------------------------------------


def test_quality_certifies_on_few_labels(spark):
    """At the size of the correctness tables the pooled cutoffs are certified; every language meets its own or those."""
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    cutoffs = quality.learn_cutoffs(documents, labels).collect()
    assert [c["stratum"] for c in cutoffs] == [None] and all(cutoffs[0][r] is not None for r in quality.RULES)
    got = quality.judge(documents, labels).collect()
    assert sum(not r["kept"] and not r["base_failed"] for r in got) > 20


def test_quality_of_many_strata(spark):
    """Cutoffs reach their strata by broadcast and beyond that by a join; strata without labels meet the pooled ones."""
    rows = [(i, " ".join(f"word{i % 7}{k}" for k in range(20)), ["aa", "bb", None, "cc"][i % 4]) for i in range(3000)]
    rows += [(10_000 + i, " ".join(f"word{k}%%%" for k in range(20)), ["aa", "bb", "new"][i % 3]) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, _, lang in rows if lang != "new"], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["kept"] == (r["row"]["doc_id"] < 10_000) for r in quality.judge(df, labels).collect())
    few, quality.FEW = quality.FEW, 0
    try:
        assert all(r["kept"] == (r["row"]["doc_id"] < 10_000) for r in quality.judge(df, labels).collect())
    finally:
        quality.FEW = few


# --- shared steps ----------------------------------------------------------------------------


def test_spread_join(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot", "b", "c", None, "none"]), k) for k in range(200)]
    stats = [("hot", 100, "H"), ("b", 1, "B"), ("c", 1, None), ("200", 1, "wrong")]
    df, of = spark.createDataFrame(rows, "k string, x long"), spark.createDataFrame(stats, "k string, n long, v string")
    got = spread_join(df, "k", of, ["v"], F.col("n") > 50, F.col("x").cast("string")).collect()
    want = {k: v for k, _, v in stats}
    assert sorted(map(str, got)) == sorted(f"Row(k={k!r}, x={x}, v={want.get(k)!r})" for k, x in rows)


def test_components_of_stars_and_chains(spark):
    links = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (700, 1030), (399, 398)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(400)} == {0} and {got[k] for k in range(1000, 1061)} == {700} and got[700] == 700 and 5000 not in got
